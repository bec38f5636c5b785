"""DOCX archives from rows (the schema of docx.scan).

Paragraphs and comments become XML as Columns; then a document's rows meet in one task, which nests the tables, numbers the images and
packs the archive. A group is one document, so it is as large as one file. The bytes depend on the rows alone (fixed dates).
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values of the format.
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
TYPE = "application/vnd.openxmlformats"
MIME = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp"}
OVERRIDES = {
    "/word/document.xml": f"{TYPE}-officedocument.wordprocessingml.document.main+xml",
    "/word/styles.xml": f"{TYPE}-officedocument.wordprocessingml.styles+xml",
    "/docProps/core.xml": f"{TYPE}-package.core-properties+xml",
    "/docProps/app.xml": f"{TYPE}-officedocument.extended-properties+xml",
}
ROOT = {"rId1": (f"{OFFICE}/relationships/officeDocument", "word/document.xml"), "rId2": (f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml"), "rId3": (f"{OFFICE}/relationships/extended-properties", "docProps/app.xml")}
NAMED = {"Title": ("Title", 48), "Heading1": ("heading 1", 38), "Heading2": ("heading 2", 30), "Heading3": ("heading 3", 26)}  # name, half points
SECTION = '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440" w:header="708" w:footer="708" w:gutter="0"/></w:sectPr>'
BORDERS = "".join(f'<w:{edge} w:val="single" w:sz="4" w:color="D6DEDC"/>' for edge in ("top", "left", "bottom", "right", "insideH", "insideV"))
UNKNOWN_SIZE, EMU, WIDEST = (400, 300), 9525, 5486400


def image_kind(b: bytes) -> str:
    if len(b) >= 8 and b[:2] == b"\x89P":
        return "png"
    if len(b) >= 3 and b[:2] == b"\xff\xd8":
        return "jpeg"
    if len(b) >= 6 and b[:2] == b"GI":
        return "gif"
    return "bmp" if b[:2] == b"BM" else "png"


def pixel_size(b: bytes) -> tuple[int, int]:
    """Width and height from the header; 400 x 300 if it has none."""
    size, kind = (0, 0), image_kind(b)
    if kind == "png" and len(b) >= 24 and b[12:16] == b"IHDR":
        size = struct.unpack(">II", b[16:24])
    elif kind == "gif" and len(b) >= 10:
        size = struct.unpack("<HH", b[6:10])
    elif kind == "bmp" and len(b) >= 26:
        w, h = struct.unpack("<ii", b[18:26])
        size = (w, abs(h))
    elif kind == "jpeg":
        at = 2
        while at + 9 <= len(b) and b[at] == 0xFF:
            marker = b[at + 1]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                size = (w, h)
                break
            at += 1 if marker == 0xFF else 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return size if min(size) > 0 else UNKNOWN_SIZE


def emu(size: tuple[int, int]) -> tuple[int, int]:
    w, h = size[0] * EMU, size[1] * EMU
    return (WIDEST, int(h * (WIDEST / w))) if w > WIDEST else (w, h)


def picture(n: int, rel: str, content: bytes) -> str:
    (w, h), name = emu(pixel_size(content)), f'id="{n}" name="Picture {n}"'
    shape = f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
    fill = f'<pic:blipFill><a:blip r:embed="{rel}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
    pic = f"<pic:pic><pic:nvPicPr><pic:cNvPr {name}/><pic:cNvPicPr/></pic:nvPicPr>{fill}{shape}</pic:pic>"
    graphic = f'<a:graphic><a:graphicData uri="{DRAWING}/picture">{pic}</a:graphicData></a:graphic>'
    inline = f'<wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent cx="{w}" cy="{h}"/><wp:docPr {name}/>{graphic}</wp:inline>'
    return f"<w:p><w:r><w:drawing>{inline}</w:drawing></w:r></w:p>"


def relationships(rels: dict[str, tuple[str, str]]) -> str:
    return XML + f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{k}" Type="{t}" Target="{to}"/>' for k, (t, to) in rels.items()) + "</Relationships>"


def content_types(extensions: list[str]) -> str:
    defaults = {"rels": f"{TYPE}-package.relationships+xml", "xml": "application/xml"} | {e: MIME[e] for e in extensions}
    body = "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in defaults.items()) + "".join(f'<Override PartName="{k}" ContentType="{v}"/>' for k, v in OVERRIDES.items())
    return f'{XML}<Types xmlns="{PACKAGE}/content-types">{body}</Types>'


def styles() -> str:
    named = "".join(
        f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{name}"/><w:basedOn w:val="Normal"/><w:rPr><w:b/><w:sz w:val="{size}"/></w:rPr></w:style>' for k, (name, size) in NAMED.items()
    )
    normal = '<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/></w:style>'
    return f'{XML}<w:styles xmlns:w="{WORD}">{normal}{named}</w:styles>'


def archive(rows: list[dict]) -> bytes:
    """The archive of one document's rows, whose paragraphs and comments have their XML."""
    inside, cells, pictures, media = defaultdict(list), defaultdict(list), {}, []
    for r in rows:
        if r["entity"] == "block":
            inside[r["parent"]].append(r)
        elif r["entity"] == "cell":
            cells[r["parent"], r["row_ix"]].append(r)
        elif r["entity"] == "image":
            pictures[r["id"]] = r["bytes"]

    def body(parent: int | None) -> str:
        return "".join(block(b) for b in sorted(inside[parent], key=lambda b: b["ord"]))

    def block(b: dict) -> str:
        if b["kind"] == "PARAGRAPH":
            return b["xml"]
        if b["kind"] == "IMAGE":
            if pictures.get(b["image_id"]) is None:
                return ""
            media.append(pictures[b["image_id"]])
            return picture(len(media), f"rId{99 + len(media)}", media[-1])
        trs = (("".join(cell(c) for c in sorted(cells[b["id"], r], key=lambda c: c["cell_ix"]))) for r in range(b["n_rows"] or 0))
        made = "".join(f"<w:tr>{x}</w:tr>" for x in trs)
        return f"<w:tbl><w:tblPr><w:tblBorders>{BORDERS}</w:tblBorders></w:tblPr>{made}</w:tbl><w:p/>" if made else ""

    def cell(c: dict) -> str:
        span = f'<w:gridSpan w:val="{c["grid_span"]}"/>' if (c["grid_span"] or 1) > 1 else ""
        inner = body(c["id"]) if inside[c["id"]] else "<w:p/>"
        return f"<w:tc><w:tcPr>{span}{'<w:vMerge/>' if c['vmerge_cont'] else ''}</w:tcPr>{inner}</w:tc>"

    said = [r["xml"] for r in sorted((r for r in rows if r["entity"] == "comment"), key=lambda r: r["ord"])]
    head = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Comments</w:t></w:r></w:p>' if said else ""
    inner = body(None) + head + "".join(said)
    spaces = f'xmlns:w="{WORD}" xmlns:r="{OFFICE}/relationships" xmlns:wp="{DRAWING}/wordprocessingDrawing" xmlns:a="{DRAWING}/main" xmlns:pic="{DRAWING}/picture"'
    names = [f"image{i + 1}.{image_kind(m)}" for i, m in enumerate(media)]
    parts: list[tuple[str, str | bytes]] = [
        ("[Content_Types].xml", content_types(list(dict.fromkeys(map(image_kind, media))))),
        ("_rels/.rels", relationships(ROOT)),
        ("docProps/core.xml", f'{XML}<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>folio</dc:creator></cp:coreProperties>'),
        ("docProps/app.xml", f'{XML}<Properties xmlns="{OFFICE}/extended-properties"><Application>folio</Application></Properties>'),
        ("word/styles.xml", styles()),
        ("word/document.xml", f"{XML}<w:document {spaces}><w:body>{inner}{SECTION}</w:body></w:document>"),
    ]
    if media:
        parts.append(("word/_rels/document.xml.rels", relationships({f"rId{100 + i}": (f"{OFFICE}/relationships/image", f"media/{x}") for i, x in enumerate(names)})))
        parts += [(f"word/media/{x}", m) for x, m in zip(names, media, strict=True)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def _write(table: pa.Table) -> pa.Table:
    content = archive(table.to_pylist())
    return pa.table({"path": table.column("path").slice(0, 1), "content": pa.array([content], pa.binary()), "length": pa.array([len(content)], pa.int64())})


def write(rows: DataFrame) -> DataFrame:
    """(path, content, length), an archive for each path of rows (docx.SCHEMA); rows of entity 'error' are left out."""
    xml = F.when((F.col("entity") == "block") & (F.col("kind") == "PARAGRAPH"), T.paragraph_xml(F.col("style"), F.coalesce("list_level", F.lit(0)), F.coalesce("runs", F.array())))
    xml = xml.when(F.col("entity") == "comment", T.comment_xml(F.col("author"), F.col("text")))
    ready = rows.where("entity <> 'error'").select("path", "entity", "id", "parent", "ord", "kind", "image_id", "n_rows", "row_ix", "cell_ix", "grid_span", "vmerge_cont", "bytes", xml.alias("xml"))
    return ready.groupBy("path").applyInArrow(_write, "path string, content binary, length long")


def _pack(table: pa.Table) -> pa.Table:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in sorted(table.to_pylist(), key=lambda r: r["name"]):
            z.writestr(zipfile.ZipInfo(r["name"]), r["content"])
    return pa.table({"path": table.column("path").slice(0, 1), "content": pa.array([out.getvalue()], pa.binary()), "length": pa.array([len(out.getvalue())], pa.int64())})


def pack(parts: DataFrame) -> DataFrame:
    """(path, content, length): an archive of the parts (path, name, content) of each path. A group is one file."""
    return parts.select("path", "name", F.col("content").cast("binary").alias("content")).groupBy("path").applyInArrow(_pack, "path string, content binary, length long")
