"""Page and image geometry."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in points: A4 page, margin, space after a block.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN, CONTENT_WIDTH, GAP = 595, 842, 48, 499, 8
MAX_PAGE, TILE_BYTES, MIB = 14400, 12 << 20, 1 << 20


#: Fixed values, in points: a blank paragraph's height (nothing follows it), the least height of a table row, the padding of a cell.
BLANK, MIN_ROW, PADDING = 12.65, 18, 4


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _cursor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds page_no and y to batches (doc_id, ord, height, gap, forced, ...) in order."""
    doc, page, y, first = None, 1, float(MARGIN), True
    for batch in batches:
        pages, places = [], []
        for i, h, g, f in zip(*(_values(batch.column(k)) for k in (0, 2, 3, 4)), strict=True):
            if first or i != doc:
                doc, page, y, first = i, 1, float(MARGIN), False
            if f:
                page, y = page + 1, float(MARGIN)
            if y + h > PAGE_HEIGHT - MARGIN:
                page, y = page + 1, float(MARGIN)
            pages.append(page)
            places.append(y)
            y = y + h + g
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.int32()), pa.array(places, pa.float64())], [*batch.schema.names, "page_no", "y"])


def paginate(blocks: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, ord, height, the carried columns, page_no, y) of blocks (doc_id, ord, height, gap, and forced if there are such): a block that does not fit, or is forced to, opens a page, even the first.

    The rows of a document come to one task in order and are streamed, so a document of any length takes no more memory than a batch.
    """
    forced = F.coalesce("forced", F.lit(False)) if "forced" in blocks.columns else F.lit(False)
    rows = blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ord").cast("int").alias("ord"), F.col("height").cast("double"), F.col("gap").cast("double"), forced.alias("forced"), *carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", page_no int, y double"
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord").mapInArrow(_cursor, schema).drop("gap", "forced")


def image_box(width: Column, height: Column) -> tuple[Column, Column]:
    """Drawn size of an image in pixels: shrunk to the content's width, however tall; null without a size (it is left out)."""
    scale = F.least(F.lit(1.0), F.lit(float(CONTENT_WIDTH)) / width)
    good = (width > 0) & (height > 0)
    return F.when(good, width * scale), F.when(good, height * scale)


def boxes(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, ord, kind, height, blank, width_px, height_px) with height, gap and forced; images without a size drop out.

    kind: PARAGRAPH, IMAGE, ROW (of a table), END (of a table), COMMENTS (the heading, on a new page) or COMMENT.
    """
    kind, (_, drawn) = F.col("kind"), image_box(F.col("width_px"), F.col("height_px"))
    blank = (kind == "PARAGRAPH") & F.col("blank")
    height = F.when(blank, BLANK).when(kind == "IMAGE", drawn).when(kind == "ROW", F.greatest(F.lit(float(MIN_ROW)), F.coalesce("height", F.lit(0.0)) + 2 * PADDING)).when(kind == "END", 0.0).otherwise(F.col("height"))
    gap = F.when(blank | (kind == "ROW"), 0.0).when(kind == "COMMENTS", 2.0 * GAP).otherwise(float(GAP))
    return blocks.select("doc_id", "ord", "kind", height.cast("double").alias("height"), gap.alias("gap"), (kind == "COMMENTS").alias("forced")).where("height IS NOT NULL")


def layout(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, kind, height, page_no, y: a whole document's blocks, in order and then its comments, on pages."""
    return paginate(boxes(blocks), "kind").where("kind <> 'END'").select("doc_id", "ord", "kind", "height", "page_no", "y")


def image_pages(images: DataFrame, by: str, order: str) -> DataFrame:
    """images with page_no in their order and the size of their page."""
    w, h = image_page(F.col("width").cast("double"), F.col("height").cast("double"))
    return images.withColumn("page_no", F.row_number().over(Window.partitionBy(by).orderBy(order))).withColumn("page_w", w).withColumn("page_h", h)


def placement(width: Column, height: Column, rotation: Column, box: tuple[Column, Column, Column, Column]) -> dict[str, Column]:
    """Coefficients of x' = a * x + b * y + c, y' = d * x + e * y + f that draw a raw image, turned, into a box (left, top, width, height)."""
    left, top, box_w, box_h = box
    shown_w, shown_h = displayed_size(width, height, rotation)
    sx, sy = box_w / shown_w, box_h / shown_h
    pick = lambda at0, at90, at180, at270: F.when(rotation == 90, at90).when(rotation == 180, at180).when(rotation == 270, at270).otherwise(at0)
    zero, one = F.lit(0.0), F.lit(1.0)
    return {
        "a": pick(one, zero, -one, zero) * sx,
        "b": pick(zero, -one, zero, one) * sx,
        "c": pick(zero, height, width, zero) * sx + left,
        "d": pick(zero, one, zero, -one) * sy,
        "e": pick(one, zero, -one, zero) * sy,
        "f": pick(zero, zero, height, width) * sy + top,
    }


def image_page(width: Column, height: Column) -> tuple[Column, Column]:
    """Rounded page size in points of an image in pixels."""
    w, h = width * 0.75, height * 0.75
    scale = F.least(F.lit(1.0), F.lit(float(MAX_PAGE)) / F.greatest(w, h))
    return tuple(F.floor(F.greatest(x * scale, F.lit(1.0)) + 0.5).cast("long") for x in (w, h))


def displayed_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    turned = rotation.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def decodes_directly(width: Column, height: Column, memory_class: int) -> Column:
    return width.cast("long") * height * 4 <= min(max(memory_class, 64), 512) * MIB // 4


def tile_rows(width: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES) / (width * 4))).cast("int")


def tiles(images: DataFrame) -> DataFrame:
    """(image columns, top, rows) of horizontal strips of images (width, height)."""
    cut = images.withColumn("tile_rows", tile_rows(F.col("width"))).withColumn("top", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.col("tile_rows"))))
    return cut.withColumn("rows", F.least(F.col("tile_rows"), F.col("height") - F.col("top"))).drop("tile_rows")


def sample_size(size: Column, wanted: Column) -> Column:
    """The power of two by which to sample while half of the size, divided by it, is at least what is wanted."""
    half = F.floor(size / 2)
    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(1).cast("long"), lambda s, _: F.when(F.floor(half / s) >= wanted, s * 2).otherwise(s))


def thumbnail_sample(width: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(1).cast("long"), lambda s, _: F.when(F.floor(width / (s * 2)) >= 200, s * 2).otherwise(s))


def column_counts(cells: DataFrame) -> DataFrame:
    """(table_id, n_columns): the widest row's span sum, a span counting 1 at least; tables without columns drop out."""
    rows = cells.groupBy("table_id", "row_ix").agg(F.sum(F.greatest("grid_span", F.lit(1))).alias("n"))
    return rows.groupBy("table_id").agg(F.max("n").alias("n_columns")).where("n_columns > 0")


def cell_places(cells: DataFrame) -> DataFrame:
    """cells with x and width of their box on the page."""
    wide = F.greatest("grid_span", F.lit(1))
    ahead = Window.partitionBy("table_id", "row_ix").orderBy("cell_ix").rowsBetween(Window.unboundedPreceding, -1)
    column = F.lit(float(CONTENT_WIDTH)) / F.col("n_columns")
    placed = cells.withColumn("before", F.coalesce(F.sum(wide).over(ahead), F.lit(0))).join(column_counts(cells), "table_id")
    return placed.withColumn("x", MARGIN + F.col("before") * column).withColumn("width", F.floor(F.greatest(F.lit(10.0), column * wide - 8)).cast("int")).drop("before")


def row_heights(cells: DataFrame) -> DataFrame:
    """Height of each table row from the cells' text heights."""
    return cells.groupBy("table_id", "row_ix").agg(F.greatest(F.lit(18.0), F.coalesce(F.max("height"), F.lit(0.0)) + 8).alias("height"))
