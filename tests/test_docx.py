"""Archives made by hand, and whole round trips."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.sources import docx, docx_writer

PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 1000, 10) + b"\x08\x06\x00\x00\x00"
REL = '<Relationships><Relationship Id="r1" Target="media/a.png"/><Relationship Id="r2" Target="media/none.png"/><Relationship Id="r3"/></Relationships>'
DRAW = '<w:drawing><wp:anchor><x><a:blip r:embed="{}"/></x></wp:anchor></w:drawing>'


def made(body, more=(), name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, f"<w:document>{body}</w:document>")
        for part, content in more:
            z.writestr(part, content)
    return out.getvalue()


def rows(content):
    return docx.document_rows("f", content)


def blocks(body, more=()):
    return [r for r in rows(made(f"<w:body>{body}</w:body>", more)) if r["entity"] == "block"]


def test_paragraphs_split_at_images():
    more = [("word/_rels/document.xml.rels", REL), ("word/media/a.png", PNG)]
    both = blocks(f"<w:p><w:r><w:t>a</w:t></w:r><w:r>{DRAW.format('r1')}<w:t>b</w:t></w:r></w:p>", more)
    assert [(b["ord"], b["kind"], [r["text"] for r in b.get("runs", [])]) for b in both] == [(0, "PARAGRAPH", ["a"]), (1, "IMAGE", []), (2, "PARAGRAPH", ["b"])]
    assert [b["kind"] for b in blocks(f"<w:p><w:r>{DRAW.format('r1')}</w:r></w:p>", more)] == ["IMAGE", "PARAGRAPH"]
    for absent in ("r2", "r3", "r4"):  # no such media, no target, no relationship
        assert [b["kind"] for b in blocks(f"<w:p><w:r>{DRAW.format(absent)}</w:r></w:p>", more)] == ["PARAGRAPH"]
    assert [b["kind"] for b in blocks(f"<w:p><w:ins><w:r>{DRAW.format('r1')}</w:r></w:ins></w:p>", more)] == ["PARAGRAPH"]


def test_paragraph_and_run_properties():
    def level(x):
        return blocks(f"<w:p><w:pPr><w:numPr>{x}</w:numPr></w:pPr></w:p>")[0]["list_level"]

    assert [level(x) for x in ("", '<w:ilvl w:val="2"/>', '<w:ilvl w:val="x"/>', '<w:ilvl w:val="-1"/>', '<w:numId w:val="0"/>')] == [1, 3, 1, 0, 1]
    styles = [blocks(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr></w:p>')[0]["style"] for s in ("Title", "Heading6", "heading1", "Heading7")]
    assert styles == ["TITLE", "HEADING3", "NORMAL", "NORMAL"]

    def run(props):
        return blocks(f"<w:p><w:r><w:rPr>{props}</w:rPr><w:t>x</w:t><w:tab/><w:br/><w:cr/><w:delText>y</w:delText></w:r></w:p>")[0]["runs"][0]

    assert run("")["text"] == "x\t\n\ny"
    assert [run(f"<w:b{v}/>")["bold"] for v in ("", ' w:val="0"', ' w:val="false"', ' w:val="off"')] == [True, False, False, True]
    assert [run(f"<w:u{v}/>")["underline"] for v in ("", ' w:val="none"', ' w:val="single"')] == [False, False, True]
    assert [run(f'<w:color w:val="{v}"/>')["color_hex"] for v in ("auto", "12345", "aBc123")] == [None, None, "aBc123"]
    assert blocks("<w:p><w:r><w:t></w:t></w:r></w:p>")[0]["runs"] == []


def test_changes_and_links():
    r = "<w:r><w:t>x</w:t></w:r><w:other><w:r><w:t>no</w:t></w:r></w:other>"
    ins, dele, link = blocks(f"<w:p><w:ins>{r}</w:ins><w:del>{r}</w:del><w:hyperlink>{r}</w:hyperlink></w:p>")[0]["runs"]
    assert (ins["is_insertion"], ins["underline"], ins["is_deletion"]) == (True, True, False)
    assert (dele["is_deletion"], dele["strikethrough"], dele["underline"]) == (True, True, False)
    assert (link["underline"], link["color_hex"], link["is_insertion"]) == (True, "0563C1", False)


def test_nested_tables():
    inner = "<w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    got = rows(made(f'<w:body><w:sectPr/><w:tbl><w:tblPr/><w:tr><w:tc><w:tcPr><w:gridSpan w:val="3"/><w:vMerge/></w:tcPr>{inner}</w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr></w:tc></w:tr><w:tr/></w:tbl></w:body>'))
    cells = [(c["id"], c["parent"], c["row_ix"], c["cell_ix"], c["grid_span"], c["vmerge_cont"]) for c in got if c["entity"] == "cell"]
    assert cells == [(0, 0, 0, 0, 3, True), (1, 1, 0, 0, 1, False), (2, 0, 0, 1, 1, False)]
    assert [(b["id"], b["parent"], b["kind"], b.get("n_rows")) for b in got if b["entity"] == "block"] == [(0, None, "TABLE", 2), (1, 0, "TABLE", 1), (2, 1, "PARAGRAPH", None)]


def test_comments():
    xml = '<c><w:comment w:author=" "><w:p>a</w:p><w:p>b</w:p></w:comment><w:comment w:author="Z "><w:p> c </w:p></w:comment><w:comment><w:p/></w:comment></c>'
    got = [(r["ord"], r["author"], r["text"]) for r in rows(made("<w:body/>", [("word/comments.xml", xml)]))]
    assert got == [(0, "Unknown", "a\nb"), (1, "Z ", "c")]


def test_files_that_cannot_be_read():
    for content in (None, b"", b"PK\x03\x04junk", made("", name="word/other.xml"), made("<w:body><w:p></w:body>")):
        got = rows(content)
        assert [r["entity"] for r in got] == ["error"] and got[0]["text"]
    assert rows(made("")) == []


def test_media_paths_and_sizes():
    assert [docx.media_part(x) for x in ("media/a.png", "/word/media/a.png", "../media/a.png", "a.png", "word/media/b/a.png")] == ["word/media/a.png"] * 5
    gif, bmp = b"GIF89a" + struct.pack("<HH", 7, 9), b"BM" + bytes(16) + struct.pack("<ii", 5, -6)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + bytes(9)
    assert [docx_writer.pixel_size(b) for b in (PNG, gif, bmp, jpeg, b"", b"\xff\xd8\xff")] == [(1000, 10), (7, 9), (5, 6), (30, 20), (400, 300), (400, 300)]
    # 0.576 as a double is below 0.576, so 95250 of it is just below 54864 and is truncated
    assert [docx_writer.emu(x) for x in ((1000, 10), (576, 10), (1152, 100))] == [(5486400, 54863), (5486400, 95250), (5486400, 476250)]


def test_sizes_as_columns(spark):
    sizes = [(1000, 10), (576, 10), (1152, 100), (577, 333), (4000, 3000)]
    df = spark.createDataFrame(sizes, "w long, h long")
    assert [tuple(r) for r in df.select(*T.emu_size(F.col("w"), F.col("h"))).collect()] == [docx_writer.emu(x) for x in sizes]


def test_round_trip_of_files(spark, tmp_path):
    """Every kind of block survives scan, write and scan; a folder is read by its *.docx files."""
    cell = f"<w:tc><w:p><w:r><w:t>c</w:t></w:r><w:r>{DRAW.format('r1')}</w:r></w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:rPr><w:i/></w:rPr><w:t>&lt;a&gt; é</w:t></w:r></w:p><w:tbl><w:tr>{cell}</w:tr></w:tbl><w:p/>'
    (tmp_path / "a.docx").write_bytes(made(f"<w:body>{body}</w:body>", [("word/_rels/document.xml.rels", REL), ("word/media/a.png", PNG), ("word/comments.xml", "<c><w:comment><w:p>hey</w:p></w:comment></c>")]))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.txt").write_bytes(b"no document")
    first = docx.read(spark, str(tmp_path))
    assert docx.errors(first).count() == 1 and docx.comments(first).select("author", "text").collect() == [("Unknown", "hey")]
    second = docx.scan(docx_writer.write(first))
    keys = ["ord", "kind", "style", "list_level", "runs", "image_id", "n_rows"]
    said = second.where("entity = 'block' AND parent IS NULL AND ord >= 3")
    # a table is followed by a paragraph of its own, and the comments end the body as paragraphs
    assert [r[0] for r in said.orderBy("ord").select(F.array_join(F.transform("runs", lambda r: r["text"]), "")).collect()] == ["", "Comments", "Unknown: hey"]
    # an image is a paragraph of its own in the archive, so it is followed by an empty paragraph more
    kinds = [(r["parent"], r["ord"], r["kind"], r["style"], [(x["text"], x["italic"]) for x in r["runs"] or []]) for r in second.where("entity = 'block' AND (parent IS NOT NULL OR ord < 3)").orderBy("id").collect()]
    empty = ("PARAGRAPH", "NORMAL", [])
    assert kinds[:2] == [(None, 0, "PARAGRAPH", "HEADING2", [("<a> é", True)]), (None, 1, "TABLE", None, [])]
    assert kinds[2:] == [(0, 0, "PARAGRAPH", "NORMAL", [("c", False)]), (0, 1, "IMAGE", None, []), (0, 2, *empty), (0, 3, *empty), (None, 2, *empty)]
    assert [bytes(r[0]) for r in docx.images(second).select("bytes").collect()] == [PNG]
    assert second.where("entity = 'cell'").count() == 1
