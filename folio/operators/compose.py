"""Whole conversions: positioned lines to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import docx, docx_writer
from . import lines as L


def line_rows(lines: DataFrame, pages: DataFrame, documents: DataFrame, page_images: DataFrame | None = None) -> DataFrame:
    """Rows of docx.SCHEMA of lines (doc_id, page_ix, line_ix, text, font_pt) on pages (doc_id, page_ix).

    A scanned page is its image (page_images: doc_id, page_ix, bytes; without one it is left out), another page its tables and styled
    paragraphs; an empty paragraph follows each page but the last.
    """
    scanned = L.scanned_pages(lines, pages).select("doc_id", "page_ix", "scanned")
    run, off, none = Window.partitionBy("doc_id", "page_ix", "run_id"), F.lit(False), F.lit(None)
    own = L.table_runs(lines).join(scanned.where("NOT scanned"), ["doc_id", "page_ix"], "left_semi")
    own = own.withColumn("at", F.when(F.col("run_id").isNotNull(), F.min("line_ix").over(run)).otherwise(F.col("line_ix")).cast("long"))
    own = own.withColumn("row_ix", (F.row_number().over(run.orderBy("line_ix")) - 1).cast("int")).withColumn("n_rows", F.count(F.lit(1)).over(run).cast("int"))
    own = own.join(L.median_fonts(lines, documents), "doc_id").withColumn("style", L.heading_style(F.col("font_pt"), F.col("median")))
    own = own.select("doc_id", "page_ix", "at", "line_ix", F.when(F.col("run_id").isNull(), "PARAGRAPH").otherwise("TABLE").alias("kind"), "style", "row_ix", "n_rows", "text")
    empty = L.page_separators(pages).select("doc_id", "page_ix", F.lit(1 << 40).alias("at"), F.lit("EMPTY").alias("kind"), "style")
    placed = own.unionByName(empty, allowMissingColumns=True).withColumn("bytes", none.cast("binary"))
    if page_images is not None:
        shown = page_images.join(scanned.where("scanned"), ["doc_id", "page_ix"], "left_semi")
        placed = placed.unionByName(shown.select("doc_id", "page_ix", F.lit(-1).cast("long").alias("at"), F.lit("IMAGE").alias("kind"), "bytes"), allowMissingColumns=True)
    placed = placed.withColumn("ord", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_ix", "at")) - 1)  # a table's lines are one block
    fields = {f.name: f.dataType for f in lines.sparkSession.createDataFrame([], docx.SCHEMA).schema if f.name != "path"}

    def row(entity: str, **values) -> Column:
        return F.struct(*(({"entity": F.lit(entity)} | values).get(n, none).cast(t).alias(n) for n, t in fields.items()))

    def runs(text: Column) -> Column:
        looks = (off.alias(n) for n in ("bold", "italic", "underline", "strikethrough", "is_insertion", "is_deletion"))
        return F.array(F.struct(text.alias("text"), *looks, none.cast("string").alias("color_hex")))

    def cell(value: Column, ix: Column) -> Column:
        """A cell, numbered by line and place in it, and the one paragraph that it holds."""
        n = number + ix
        held = row("block", id=-1 - n, parent=n, ord=F.lit(0), kind=F.lit("PARAGRAPH"), style=F.lit("NORMAL"), runs=runs(value))
        return F.array(row("cell", id=n, parent=ord_, row_ix=F.col("row_ix"), cell_ix=ix, grid_span=F.lit(1), vmerge_cont=off), held)

    kind, ord_ = F.col("kind"), F.col("ord").cast("long")
    number = F.col("page_ix").cast("long") * (1 << 44) + F.col("line_ix").cast("long") * (1 << 20)
    page, block = F.col("page_ix").cast("long"), {"id": ord_, "ord": ord_}
    cells = F.flatten(F.transform(T.split_cells(F.col("text")), cell))
    grid = F.when(F.col("row_ix") == 0, F.array(row("block", **block, kind=kind, n_rows=F.col("n_rows")))).otherwise(F.array())
    made = (
        F.when(kind == "PARAGRAPH", F.array(row("block", **block, kind=kind, style=F.col("style"), runs=runs(F.col("text")))))
        .when(kind == "TABLE", F.concat(grid, cells))
        .when(kind == "EMPTY", F.array(row("block", **block, kind=F.lit("PARAGRAPH"), style=F.col("style"), runs=F.array().cast(f"array<{docx.RUN}>"))))
        .otherwise(F.array(row("block", **block, kind=kind, image_id=page), row("image", id=page, bytes=F.col("bytes"))))
    )
    return placed.select(F.col("doc_id").cast("string").alias("path"), F.explode(made).alias("r")).select("path", "r.*")


def lines_to_docx(lines: DataFrame, pages: DataFrame, documents: DataFrame, page_images: DataFrame | None = None) -> DataFrame:
    """(path, content, length): a document for each doc_id that has lines or pages."""
    return docx_writer.write(line_rows(lines, pages, documents, page_images))
