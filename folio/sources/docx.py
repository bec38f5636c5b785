"""DOCX archives as rows: one scan makes the blocks, cells, images and comments of every file.

A file is parsed whole in one task, as its relationships and media are in the same archive; so image references are resolved there and
nothing is shuffled. Rows of all kinds come from one pass (`entity` tells which); `blocks`, `cells`, `images` and `comments` select theirs.
Tables nest to any depth by ids: a cell's parent is its table's block id, a block's parent its cell id (null in the body).

A null or unreadable archive, one without word/document.xml, and malformed XML give one row of entity 'error' with the reason in text, and no
other row of that file. A document without w:body gives no rows.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree.ElementTree import Element, TreeBuilder
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STYLES

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,is_insertion:boolean,is_deletion:boolean,color_hex:string>"
SCHEMA = (
    "path string, entity string, id long, parent long, ord int, kind string, style string, list_level int, "
    f"runs array<{RUN}>, image_id long, n_rows int, row_ix int, cell_ix int, grid_span int, vmerge_cont boolean, author string, text string, bytes binary"
)
_RUN = pa.struct([("text", pa.string()), *((k, pa.bool_()) for k in ("bold", "italic", "underline", "strikethrough", "is_insertion", "is_deletion")), ("color_hex", pa.string())])
_LONG, _INT, _STRING = pa.int64(), pa.int32(), pa.string()
ARROW = pa.schema(
    [("path", _STRING), ("entity", _STRING), ("id", _LONG), ("parent", _LONG), ("ord", _INT), ("kind", _STRING), ("style", _STRING), ("list_level", _INT), ("runs", pa.list_(_RUN)), ("image_id", _LONG)]
    + [("n_rows", _INT), ("row_ix", _INT), ("cell_ix", _INT), ("grid_span", _INT), ("vmerge_cont", pa.bool_()), ("author", _STRING), ("text", _STRING), ("bytes", pa.binary())]
)

#: The parts of an archive that are read, and the colour of links.
DOCUMENT, RELATIONSHIPS, COMMENTS, MEDIA = "word/document.xml", "word/_rels/document.xml.rels", "word/comments.xml", "word/media/"
LINK_COLOUR = "0563C1"


def wanted_part(name: str) -> bool:
    return name in (DOCUMENT, RELATIONSHIPS, COMMENTS) or name.startswith(MEDIA)


def archive_parts(content: bytes) -> dict[str, bytes]:
    """The wanted parts; only these are unpacked. Of equal names the last counts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir() and wanted_part(i.filename)}


def tree(xml: bytes) -> Element:
    """Elements named as written, prefix included."""
    builder, parser = TreeBuilder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = builder.start, builder.end, builder.data
    parser.Parse(xml, True)
    return builder.close()


def media_part(target: str) -> str:
    target = target.removeprefix("/")
    return f"word/{target}" if target.startswith("media/") else MEDIA + target.rpartition("/")[2]


def relationships(xml: bytes) -> dict[str, str]:
    return {r.get("Id"): r.get("Target") for r in tree(xml).iter("Relationship") if None not in (r.get("Id"), r.get("Target"))}


def comment_rows(xml: bytes) -> list[tuple[str, str]]:
    """(author, text) of each comment that has text; each paragraph ends a line."""

    def gather(e: Element, text: str) -> str:
        text += e.text or ""
        for child in e:
            text = gather(child, text)
            if child.tag == "w:p" and text and text[-1] != "\n":
                text += "\n"
            text += child.tail or ""
        return text

    out = []
    for c in tree(xml).iter("w:comment"):
        author, text = c.get("w:author") or "", gather(c, "").strip()
        if text:
            out.append((author if author.strip() else "Unknown", text))
    return out


def _int(value: str | None, default: int) -> int:
    good = value is not None and re.fullmatch(r"[+-]?[0-9]+", value) and -(1 << 31) <= int(value) < 1 << 31
    return int(value) if good else default


def _on(e: Element) -> bool:
    return e.get("w:val") not in ("false", "0")


class Body:
    """Rows of a document's body."""

    def __init__(self, path: str, rels: dict[str, str], media: dict[str, bytes]):
        self.path, self.rels, self.media = path, rels, media
        self.rows: list[dict] = []
        self.n_blocks = self.n_cells = self.n_images = 0

    def block(self, parent: int | None, at: int, kind: str, **more) -> int:
        self.rows.append({"path": self.path, "entity": "block", "id": self.n_blocks, "parent": parent, "ord": at, "kind": kind, **more})
        self.n_blocks += 1
        return self.n_blocks - 1

    def blocks(self, holder: Element, parent: int | None) -> None:
        at = 0
        for e in holder:
            if e.tag == "w:p":
                at = self.paragraph(e, parent, at)
            elif e.tag == "w:tbl":
                self.table(e, parent, at)
                at += 1

    def table(self, e: Element, parent: int | None, at: int) -> None:
        rows = e.findall("w:tr")
        table = self.block(parent, at, "TABLE", n_rows=len(rows))
        for r, row in enumerate(rows):
            for c, cell in enumerate(row.findall("w:tc")):
                span, merged = 1, False
                for props in cell.findall("w:tcPr"):
                    spans, merges = props.findall("w:gridSpan"), props.findall("w:vMerge")
                    span = _int(spans[-1].get("w:val"), 1) if spans else 1
                    merged = bool(merges) and merges[-1].get("w:val", "continue") == "continue"
                own, self.n_cells = self.n_cells, self.n_cells + 1
                self.rows.append({"path": self.path, "entity": "cell", "id": own, "parent": table, "row_ix": r, "cell_ix": c, "grid_span": span, "vmerge_cont": merged})
                self.blocks(cell, own)

    def paragraph(self, e: Element, parent: int | None, at: int) -> int:
        """Adds one paragraph, or more where images split it; returns the next ordinal."""
        style, level, runs = "NORMAL", 0, []

        def flush():
            nonlocal at, runs
            self.block(parent, at, "PARAGRAPH", style=style, list_level=level, runs=runs)
            at, runs = at + 1, []

        for child in e:
            if child.tag == "w:pPr":
                style = "NORMAL"
                for p in child.findall("w:pStyle"):
                    style = STYLES.get(p.get("w:val"), "NORMAL")
                for numbering in child.findall("w:numPr"):
                    depth = [_int(x.get("w:val"), 0) for x in numbering.findall("w:ilvl")]
                    level = depth[-1] + 1 if depth and depth[-1] >= 0 else level if depth else 1
            elif child.tag == "w:r":
                run, image = self.run(child)
                if image is not None:
                    if runs:
                        flush()
                    self.rows.append({"path": self.path, "entity": "image", "id": self.n_images, "bytes": image})
                    self.block(parent, at, "IMAGE", image_id=self.n_images)
                    self.n_images, at = self.n_images + 1, at + 1
                runs += run
            elif child.tag == "w:ins":
                runs += [r | {"is_insertion": True, "underline": True} for r in self.inner(child)]
            elif child.tag == "w:del":
                runs += [r | {"is_deletion": True, "strikethrough": True} for r in self.inner(child)]
            elif child.tag == "w:hyperlink":
                runs += [r | {"underline": True, "color_hex": r["color_hex"] or LINK_COLOUR} for r in self.inner(child)]
        flush()
        return at

    def inner(self, wrapper: Element) -> list[dict]:
        return [r for child in wrapper.findall("w:r") for r in self.run(child)[0]]

    def run(self, e: Element) -> tuple[list[dict], bytes | None]:
        """The run, unless its text is empty, and its last drawing's image, if the archive has it."""
        text, look, image = "", {}, None
        for child in e:
            if child.tag in ("w:t", "w:delText"):
                text += "".join(child.itertext())
            elif child.tag == "w:tab":
                text += "\t"
            elif child.tag in ("w:br", "w:cr"):
                text += "\n"
            elif child.tag == "w:rPr":
                look = self.look(child)
            elif child.tag == "w:drawing":
                ids = [b.get("r:embed") for b in child.iter("a:blip") if b.get("r:embed") is not None]
                image = self.media.get(media_part(self.rels[ids[-1]])) if ids and ids[-1] in self.rels else None
        plain = {"text": text, "bold": False, "italic": False, "underline": False, "strikethrough": False, "is_insertion": False, "is_deletion": False, "color_hex": None}
        return [plain | look] if text else [], image

    @staticmethod
    def look(props: Element) -> dict:
        out = {}
        for p in props:
            value = p.get("w:val")
            if p.tag in ("w:b", "w:i", "w:strike"):
                out[{"w:b": "bold", "w:i": "italic", "w:strike": "strikethrough"}[p.tag]] = _on(p)
            elif p.tag == "w:u":
                out["underline"] = value not in (None, "none")
            elif p.tag == "w:color" and value is not None and re.fullmatch("[0-9A-Fa-f]{6}", value):
                out["color_hex"] = value
        return out


def document_rows(path: str, content: bytes | None) -> list[dict]:
    try:
        parts = archive_parts(content or b"")
        if DOCUMENT not in parts:
            raise ValueError(f"no {DOCUMENT} in the archive")
        rels = relationships(parts[RELATIONSHIPS]) if RELATIONSHIPS in parts else {}
        body = Body(path, rels, parts)
        for holder in tree(parts[DOCUMENT]).iter("w:body"):
            body.blocks(holder, None)
            break
        said = comment_rows(parts[COMMENTS]) if COMMENTS in parts else []
        return body.rows + [{"path": path, "entity": "comment", "ord": i, "author": a, "text": t} for i, (a, t) in enumerate(said)]
    except (zipfile.BadZipFile, expat.ExpatError, ValueError, EOFError, NotImplementedError, RuntimeError, OSError, zlib.error) as e:
        return [{"path": path, "entity": "error", "text": str(e) or type(e).__name__}]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = document_rows(path, content.as_py())
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[k : k + 4096], schema=ARROW)


def scan(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from files (path, content, ...)."""
    return files.select("path", "content").mapInArrow(_scan, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """scan() of every .docx file at path."""
    return scan(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path))


def blocks(rows: DataFrame) -> DataFrame:
    return rows.where("entity = 'block'").select("path", F.col("id").alias("block_id"), F.col("parent").alias("parent_cell_id"), "ord", "kind", "style", "list_level", "runs", "image_id", "n_rows")


def cells(rows: DataFrame) -> DataFrame:
    return rows.where("entity = 'cell'").select("path", F.col("parent").alias("table_block_id"), "row_ix", "cell_ix", F.col("id").alias("cell_id"), "grid_span", "vmerge_cont")


def images(rows: DataFrame) -> DataFrame:
    return rows.where("entity = 'image'").select("path", F.col("id").alias("image_id"), "bytes")


def comments(rows: DataFrame) -> DataFrame:
    return rows.where("entity = 'comment'").select("path", F.col("ord").alias("ix"), "author", "text")


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("entity = 'error'").select("path", F.col("text").alias("error"))
