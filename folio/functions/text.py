"""Scalar functions on text, sizes, styles and paths, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space for trimming and blank tests, styles, their ids and point sizes.
WHITE = r"[\x09-\x0D\x1C-\x20\p{Z}]"
STYLES = {"Title": "TITLE", "Heading1": "HEADING1", "Heading2": "HEADING2", "Heading3": "HEADING3", "Heading4": "HEADING3", "Heading5": "HEADING3", "Heading6": "HEADING3"}
STYLE_IDS = {"TITLE": "Title", "HEADING1": "Heading1", "HEADING2": "Heading2", "HEADING3": "Heading3"}
POINTS = {"TITLE": 24.0, "HEADING1": 19.0, "HEADING2": 15.0, "HEADING3": 12.5, "NORMAL": 11.0}
LONG_MAX = 9223372036854775807


def trim_white(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def is_blank(c: Column) -> Column:
    return c.rlike(f"^{WHITE}*$")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def parse_size(c: Column) -> Column:
    """Bytes of '2.5 mb'; no unit means KB; null if it is no positive size. Too large values saturate."""
    s = F.upper(trim_white(c))
    pattern = r"^([0-9]+(?:\.[0-9]+)?)\s*(B|KB|MB|GB)?$"
    unit = F.regexp_extract(s, pattern, 2)
    factor = F.when(unit == "B", 1).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1 << 10)
    value = F.regexp_extract(s, pattern, 1).try_cast("double") * factor
    whole = F.when(value >= float(LONG_MAX), F.lit(LONG_MAX)).otherwise(F.floor(F.least(value, F.lit(9e18))))
    return F.when(value.isNotNull() & (whole > 0), whole)


def format_size(c: Column) -> Column:
    """'1.3 KB': half up, with a point."""
    return (
        F.when(c < 1024, F.format_string("%d B", c))
        .when(c < 1 << 20, F.format_string("%.1f KB", c / 1024.0))
        .when(c < 1 << 30, F.format_string("%.1f MB", c / 1048576.0))
        .otherwise(F.format_string("%.2f GB", c / 1073741824.0))
    )


def escape_xml(c: Column) -> Column:
    out = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def media_path(c: Column) -> Column:
    """The archive path of a relationship's target."""
    s = F.regexp_replace(c, "^/", "")
    return F.when(s.startswith("media/"), F.concat(F.lit("word/"), s)).otherwise(F.concat(F.lit("word/media/"), F.substring_index(s, "/", -1)))


def split_cells(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, " {2,}|\t"), trim_white), lambda x: x != "")


def image_type(c: Column) -> Column:
    """png, jpeg, gif or bmp by the leading bytes; png if unknown."""
    n, head = F.octet_length(c), F.hex(F.substring(c, 1, 2))
    return F.when((head == "8950") & (n >= 8), "png").when((head == "FFD8") & (n >= 3), "jpeg").when((head == "4749") & (n >= 6), "gif").when((head == "424D") & (n >= 2), "bmp").otherwise("png")


def mime_type(extension: Column) -> Column:
    return F.when(extension.isin("jpg", "jpeg"), "image/jpeg").when(extension == "gif", "image/gif").when(extension == "bmp", "image/bmp").otherwise("image/png")


def is_colour(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]{6}$")


def flag(present: Column, value: Column) -> Column:
    """An on/off property: on if the element is there, unless its value is false or 0."""
    return present & F.coalesce(~value.isin("false", "0"), F.lit(True))


def int_or(c: Column, default: int) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def list_prefix(level: Column, spaces: int) -> Column:
    """Indent and bullet of a list item; one space after it in documents, two in layout."""
    return F.when(level >= 1, F.concat(F.repeat(F.lit("    "), level - 1), F.lit("•" + " " * spaces))).otherwise("")


def _case(c: Column, table: dict, default) -> Column:
    out = F.when(F.lit(False), F.lit(default))
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def style_of_id(c: Column) -> Column:
    return _case(c, STYLES, "NORMAL")


def style_id(c: Column) -> Column:
    return _case(c, STYLE_IDS, None)


def style_points(c: Column) -> Column:
    return _case(c, POINTS, 11.0)


def emu_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Drawing size of a pixel size: 9525 a pixel, at most 5486400 wide; the height times the ratio (a double), truncated."""
    w, h = width * 9525, height * 9525
    return F.least(w, F.lit(5486400)).cast("long"), F.when(w > 5486400, F.floor(h * (F.lit(5486400.0) / w))).otherwise(h).cast("long")


def run_xml(run: Column) -> Column:
    on = lambda name, xml: F.when(run[name], xml).otherwise("")
    colour = F.when(run["color_hex"].isNotNull(), F.concat(F.lit('<w:color w:val="'), run["color_hex"], F.lit('"/>'))).otherwise("")
    props = F.concat(on("bold", "<w:b/>"), on("italic", "<w:i/>"), on("underline", '<w:u w:val="single"/>'), on("strikethrough", "<w:strike/>"), colour)
    return F.concat(F.lit("<w:r>"), F.when(props != "", F.concat(F.lit("<w:rPr>"), props, F.lit("</w:rPr>"))).otherwise(""), F.lit('<w:t xml:space="preserve">'), escape_xml(run["text"]), F.lit("</w:t></w:r>"))


def paragraph_xml(style: Column, level: Column, runs: Column) -> Column:
    sid = style_id(style)
    head = F.when(sid.isNotNull(), F.concat(F.lit('<w:pStyle w:val="'), sid, F.lit('"/>'))).otherwise("")
    bullet = F.when(level >= 1, F.concat(F.lit('<w:r><w:t xml:space="preserve">'), list_prefix(level, 1), F.lit("</w:t></w:r>"))).otherwise("")
    return F.concat(F.lit("<w:p><w:pPr>"), head, F.lit("</w:pPr>"), bullet, F.array_join(F.transform(runs, run_xml), ""), F.lit("</w:p>"))


def comment_xml(author: Column, text: Column) -> Column:
    who = F.when(author.isNull() | is_blank(author), "Unknown").otherwise(author)
    return F.concat(
        F.lit('<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">'), escape_xml(who), F.lit(': </w:t></w:r><w:r><w:t xml:space="preserve">'), escape_xml(text), F.lit("</w:t></w:r></w:p>")
    )
