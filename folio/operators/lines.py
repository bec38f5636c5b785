"""Structure from positioned text lines: table runs, median font, headings, scanned pages, separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def text_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, page_ix, line_ix, text, font_pt) of plain documents. The font and the page are stand-ins: text has neither."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_ix", "text"))
    return rows.select("doc_id", F.floor(F.col("line_ix") / 40).cast("int").alias("page_ix"), "line_ix", "text", (9 + F.length("text") % 12).cast("float").alias("font_pt")).where(~T.is_blank(F.col("text")))


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """Text lines of glyphs (doc_id, page_ix, line_ix, ord, text, x, y, size): text in order, place of the first glyph, largest size; blank lines drop out."""
    row = glyphs.groupBy("doc_id", "page_ix", "line_ix").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda g: g["text"]), "").alias("text"),
        F.min_by("x", "ord").alias("x"),
        F.min_by("y", "ord").alias("y"),
        F.max("size").cast("float").alias("font_pt"),
    )
    return row.where(~T.is_blank(F.col("text")))


def in_reading_order(lines: DataFrame) -> DataFrame:
    """lines with line_ix anew, by page, from the top, from the left."""
    return lines.withColumn("line_ix", F.row_number().over(Window.partitionBy("doc_id", "page_ix").orderBy("y", "x", "line_ix")) - 1)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


def table_runs(lines: DataFrame) -> DataFrame:
    """lines with n_cells, and run_id of maximal runs of two or more lines with one cell count of two or more (else null). Runs stay on a page."""
    page = Window.partitionBy("doc_id", "page_ix").orderBy("line_ix")
    counted = lines.withColumn("n_cells", F.size(T.split_cells(F.col("text"))))
    new = F.coalesce((F.lag("n_cells").over(page) != F.col("n_cells")).cast("int"), F.lit(1))
    run = counted.withColumn("new", new).withColumn("run_id", F.sum("new").over(page))
    size = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_ix", "run_id"))
    return run.withColumn("run_id", F.when((F.col("n_cells") >= 2) & (size >= 2), F.col("run_id"))).drop("new")


def median_fonts(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Upper median of the positive fonts of each document, 11 without any."""
    own = lines.where("font_pt > 0").groupBy("doc_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY font_pt DESC)").cast("float").alias("median"))
    return documents.select("doc_id").join(own, "doc_id", "left").select("doc_id", F.coalesce("median", F.lit(11.0).cast("float")).alias("median"))


def heading_style(font: Column, median: Column) -> Column:
    times = lambda f: median * F.lit(f).cast("float")
    return F.when(median <= 0, "NORMAL").when(font >= times(1.8), "TITLE").when(font >= times(1.4), "HEADING1").when(font >= times(1.2), "HEADING2").otherwise("NORMAL")


def page_blocks(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a block: a table for each run, else a paragraph a line with its style."""
    runs = table_runs(lines).join(median_fonts(lines, documents), "doc_id")
    block = F.when(F.col("run_id").isNotNull(), F.concat(F.lit("t"), "run_id")).otherwise(F.concat(F.lit("p"), "line_ix"))
    styled = runs.withColumn("block", block).withColumn("style", F.when(F.col("run_id").isNull(), heading_style(F.col("font_pt"), F.col("median"))))
    return styled.groupBy("doc_id", "page_ix", "block").agg(F.min("line_ix").alias("ord"), F.when(F.max("run_id").isNotNull(), "TABLE").otherwise("PARAGRAPH").alias("kind"), F.max("style").alias("style"), F.count(F.lit(1)).alias("n_lines"))


def scanned_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (doc_id, page_ix) with n_units and scanned: under 20 UTF-16 units of text, or no lines."""
    units = lines.groupBy("doc_id", "page_ix").agg(F.sum(T.utf16_length(F.col("text"))).alias("n_units"))
    return pages.join(units, ["doc_id", "page_ix"], "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)).cast("long")).withColumn("scanned", F.col("n_units") < 20)


def page_separators(pages: DataFrame) -> DataFrame:
    """An empty paragraph behind every page but a document's last."""
    after = F.lead("page_ix").over(Window.partitionBy("doc_id").orderBy("page_ix"))
    return pages.withColumn("after", after).where("after IS NOT NULL").select("doc_id", "page_ix", F.lit("NORMAL").alias("style"))
