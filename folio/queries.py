"""Queries over the test tables, and the same in DuckDB SQL.

The tables hold plain text, so some inputs are stand-ins, made alike on both sides: cells from ', ', fonts from line lengths, pages of 40
lines, relationship chains from orders, image sizes and probes from part keys.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import compose, layout, lines, ordered, search
from .sources import docx, docx_writer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LINES = """l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l1 AS (SELECT doc_id, unnest(range(len(a))) AS line_ix, unnest(a) AS text FROM l0),
l AS (SELECT doc_id, line_ix // 40 AS page_ix, line_ix, text, 9 + length(text) % 12 AS font FROM l1 WHERE NOT regexp_full_match(text, '[\\x09-\\x0D\\x1C-\\x20\\p{Z}]*'))"""
CELLS = "list_filter(list_transform(string_split_regex(replace(text, ', ', '  '), ' {2,}|\\t'), lambda x: regexp_replace(x, '^[\\x09-\\x0D\\x1C-\\x20\\p{Z}]+|[\\x09-\\x0D\\x1C-\\x20\\p{Z}]+$', '', 'g')), lambda x: x <> '')"
ESCAPED = "replace(replace(replace(replace(replace(regexp_replace({0}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def own_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.text_lines(table(spark, sf, "documents"))


def cell_lines(spark: SparkSession, sf: str) -> DataFrame:
    return own_lines(spark, sf).withColumn("text", F.replace("text", F.lit(", "), F.lit("  ")))


def own_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 40).cast("int"))).alias("page_ix"))


RUNS = f"""{LINES}, c AS (SELECT doc_id, page_ix, line_ix, font, len({CELLS}) AS n_cells FROM l),
n AS (SELECT *, CASE WHEN lag(n_cells) OVER w = n_cells THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id, page_ix ORDER BY line_ix)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_ix ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS run FROM n),
q AS (SELECT *, CASE WHEN n_cells >= 2 AND count(*) OVER (PARTITION BY doc_id, page_ix, run) >= 2 THEN run END AS run_id FROM r),
m AS (SELECT doc_id, quantile_disc(font, 0.5 ORDER BY font DESC) AS median FROM l GROUP BY doc_id)"""
STYLE = "CASE WHEN median <= 0 THEN 'NORMAL' " + " ".join(f"WHEN CAST(font AS FLOAT) >= CAST(median AS FLOAT) * CAST({k} AS FLOAT) THEN '{v}'" for k, v in (("1.8", "TITLE"), ("1.4", "HEADING1"), ("1.2", "HEADING2"))) + " ELSE 'NORMAL' END"


@query(f"""WITH {RUNS}, b AS (SELECT doc_id, page_ix, coalesce('t' || run_id, 'p' || line_ix) AS block, max(run_id) AS run_id, count(*) AS n_lines,
max(CASE WHEN run_id IS NULL THEN {STYLE} END) AS style FROM q JOIN m USING (doc_id) GROUP BY 1, 2, 3)
SELECT doc_id, CASE WHEN run_id IS NULL THEN 'PARAGRAPH' ELSE 'TABLE' END AS kind, coalesce(style, '-') AS style, count(*) AS n_blocks, CAST(sum(n_lines) AS BIGINT) AS n_lines FROM b GROUP BY 1, 2, 3""")
def document_structure(spark: SparkSession, sf: str) -> DataFrame:
    blocks = lines.page_blocks(cell_lines(spark, sf), table(spark, sf, "documents"))
    return blocks.groupBy("doc_id", "kind", F.coalesce("style", F.lit("-")).alias("style")).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_lines").alias("n_lines"))


@query(f"WITH {LINES} SELECT doc_id, line_ix, len({CELLS}) AS n_cells, array_to_string({CELLS}, '|') AS cells FROM l")
def cell_split(spark: SparkSession, sf: str) -> DataFrame:
    c = T.split_cells(F.col("text"))
    return cell_lines(spark, sf).select("doc_id", F.col("line_ix").cast("long").alias("line_ix"), F.size(c).cast("long").alias("n_cells"), F.array_join(c, "|").alias("cells"))


@query(f"WITH {RUNS} SELECT doc_id, page_ix, min(line_ix) AS first_line, count(*) AS n_lines, max(n_cells) AS n_cells FROM q WHERE run_id IS NOT NULL GROUP BY doc_id, page_ix, run_id")
def table_runs(spark: SparkSession, sf: str) -> DataFrame:
    r = lines.table_runs(cell_lines(spark, sf)).where("run_id IS NOT NULL").groupBy("doc_id", "page_ix", "run_id")
    return r.agg(F.min("line_ix").cast("long").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.max("n_cells").cast("long").alias("n_cells")).select("doc_id", F.col("page_ix").cast("long").alias("page_ix"), "first_line", "n_lines", "n_cells")


@query(f"WITH {RUNS} SELECT d.doc_id, CAST(coalesce(median, 11) AS DOUBLE) AS median FROM documents d LEFT JOIN m USING (doc_id)")
def upper_median_font(spark: SparkSession, sf: str) -> DataFrame:
    return lines.median_fonts(own_lines(spark, sf), table(spark, sf, "documents")).withColumn("median", F.col("median").cast("double"))


@query(f"WITH {RUNS} SELECT doc_id, {STYLE} AS style, count(*) AS n_lines FROM l JOIN m USING (doc_id) GROUP BY 1, 2")
def heading_classify(spark: SparkSession, sf: str) -> DataFrame:
    own = own_lines(spark, sf)
    style = lines.heading_style(F.col("font_pt"), F.col("median"))
    return own.join(lines.median_fonts(own, table(spark, sf, "documents")), "doc_id").groupBy("doc_id", style.alias("style")).agg(F.count(F.lit(1)).alias("n_lines"))


PAGES = f"{LINES}, p AS (SELECT doc_id, unnest(range((len(a) - 1) // 40 + 1)) AS page_ix FROM l0)"


@query(f"""WITH {PAGES}, u AS (SELECT doc_id, page_ix, sum(length(text)) AS n FROM l GROUP BY 1, 2)
SELECT p.doc_id, p.page_ix, CAST(coalesce(n, 0) AS BIGINT) AS n_units, coalesce(n, 0) < 20 AS scanned FROM p LEFT JOIN u ON p.doc_id = u.doc_id AND p.page_ix = u.page_ix""")
def scanned_pages(spark: SparkSession, sf: str) -> DataFrame:
    return lines.scanned_pages(own_lines(spark, sf), own_pages(spark, sf)).withColumn("page_ix", F.col("page_ix").cast("long"))


@query(f"WITH {PAGES}, x AS (SELECT *, lead(page_ix) OVER (PARTITION BY doc_id ORDER BY page_ix) AS after FROM p) SELECT doc_id, page_ix, 'NORMAL' AS style FROM x WHERE after IS NOT NULL")
def page_separators(spark: SparkSession, sf: str) -> DataFrame:
    return lines.page_separators(own_pages(spark, sf)).withColumn("page_ix", F.col("page_ix").cast("long"))


@query(f"""SELECT 'documents' AS origin, doc_id AS id, length({ESCAPED.format('text')}) AS n_chars, md5({ESCAPED.format('text')}) AS digest FROM documents
UNION ALL SELECT 'pages', page_id, length({ESCAPED.format('html')}), md5({ESCAPED.format('html')}) FROM pages""")
def xml_escape(spark: SparkSession, sf: str) -> DataFrame:
    def part(name: str, key: str, column: str) -> DataFrame:
        e = T.escape_xml(F.col(column))
        return table(spark, sf, name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), F.length(e).cast("long").alias("n_chars"), F.md5(e).alias("digest"))

    return part("documents", "doc_id", "text").unionByName(part("pages", "page_id", "html"))


HALF_UP = "CAST((2 * {n} * {p} + {u}) // (2 * CAST({u} AS BIGINT)) AS BIGINT)"


def _shown(u: int, name: str, digits: int) -> str:
    p = 10**digits
    t = HALF_UP.format(n="n", p=p, u=u)
    return f"CAST({t} // {p} AS VARCHAR) || '.' || lpad(CAST({t} % {p} AS VARCHAR), {digits}, '0') || ' {name}'"


@query(f"""WITH s AS (SELECT doc_id, k, CAST(n_chars AS BIGINT) * k AS n FROM documents, (SELECT unnest([1, 37, 1024, 1048576]) AS k))
SELECT doc_id, k, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN {_shown(1024, 'KB', 1)} WHEN n < 1073741824 THEN {_shown(1 << 20, 'MB', 1)} ELSE {_shown(1 << 30, 'GB', 2)} END AS shown FROM s""")
def size_format(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.explode(F.array(*map(F.lit, (1, 37, 1024, 1048576)))).alias("k"))
    return d.select("doc_id", "k", T.format_size(F.col("n_chars") * F.col("k")).alias("shown"))


@query("""WITH s AS (SELECT p_partkey, CAST(CASE p_partkey % 8 WHEN 0 THEN p_size || ' KB' WHEN 1 THEN p_size || '.5 mb' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN p_size || 'B' WHEN 4 THEN ' ' || p_size || ' gB '
WHEN 5 THEN '.' || p_size WHEN 6 THEN p_size || '.' ELSE '-' || p_size END AS VARCHAR) AS given FROM part),
m AS (SELECT *, regexp_extract(upper(trim(given)), '^([0-9]+(?:\\.[0-9]+)?)\\s*(B|KB|MB|GB)?$', 1) AS v, regexp_extract(upper(trim(given)), '^([0-9]+(?:\\.[0-9]+)?)\\s*(B|KB|MB|GB)?$', 2) AS u FROM s)
SELECT p_partkey, given, CAST(trunc(TRY_CAST(v AS DOUBLE) * CASE u WHEN 'B' THEN 1 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1024 END) AS BIGINT) AS bytes FROM m""")
def size_parse(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    forms = (F.concat(s, F.lit(" KB")), F.concat(s, F.lit(".5 mb")), s, F.concat(s, F.lit("B")), F.concat(F.lit(" "), s, F.lit(" gB ")), F.concat(F.lit("."), s), F.concat(s, F.lit(".")))
    given = F.concat(F.lit("-"), s)
    for i, form in reversed(list(enumerate(forms))):
        given = F.when(k == i, form).otherwise(given)
    return table(spark, sf, "part").select("p_partkey", given.alias("given")).withColumn("bytes", T.parse_size(F.col("given")))


@query("""WITH s AS (SELECT doc_id, (['Title', 'Heading1', 'Heading2', 'Heading3', 'Heading5', 'heading1', 'Quote'])[1 + doc_id % 7] AS given FROM documents),
t AS (SELECT *, CASE given WHEN 'Title' THEN 'TITLE' WHEN 'Heading1' THEN 'HEADING1' WHEN 'Heading2' THEN 'HEADING2' WHEN 'Heading3' THEN 'HEADING3' WHEN 'Heading5' THEN 'HEADING3' ELSE 'NORMAL' END AS style FROM s)
SELECT doc_id, style, CASE style WHEN 'TITLE' THEN 'Title' WHEN 'HEADING1' THEN 'Heading1' WHEN 'HEADING2' THEN 'Heading2' WHEN 'HEADING3' THEN 'Heading3' END AS style_id,
CAST(CASE style WHEN 'TITLE' THEN 24 WHEN 'HEADING1' THEN 19 WHEN 'HEADING2' THEN 15 WHEN 'HEADING3' THEN 12.5 ELSE 11 END AS DOUBLE) AS points FROM t""")
def style_map(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.array(*map(F.lit, ("Title", "Heading1", "Heading2", "Heading3", "Heading5", "heading1", "Quote")))
    d = table(spark, sf, "documents").select("doc_id", T.style_of_id(F.element_at(ids, (F.col("doc_id") % 7 + 1).cast("int"))).alias("style"))
    return d.withColumn("style_id", T.style_id(F.col("style"))).withColumn("points", T.style_points(F.col("style")))


@query("""WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'media/' || page_id || '.png' WHEN 2 THEN '/word/media/' || page_id || '.png' ELSE '../media/' || page_id || '.png' END AS target FROM pages),
t AS (SELECT page_id, regexp_replace(target, '^/', '') AS x FROM s)
SELECT page_id, CASE WHEN starts_with(x, 'media/') THEN 'word/' || x ELSE 'word/media/' || string_split(x, '/')[-1] END AS path FROM t""")
def media_path(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("page_id") % 4, F.concat(F.col("page_id").cast("string"), F.lit(".png"))
    target = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("media/"), name)).when(k == 2, F.concat(F.lit("/word/media/"), name)).otherwise(F.concat(F.lit("../media/"), name))
    return table(spark, sf, "pages").select("page_id", T.media_path(target).alias("path"))


@query("""SELECT c_mktsegment, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def lookup_chain(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return found.groupBy("c_mktsegment", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def optional_part(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return found.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2)
SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY o) AS kinds FROM f GROUP BY 1""")
def distinct_ext(spark: SparkSession, sf: str) -> DataFrame:
    found = ordered.distinct_in_order(table(spark, sf, "events"), ["user_id"], "event_id", "event_type")
    return found.select("user_id", F.size("values").cast("long").alias("n"), F.array_join("values", ",").alias("kinds"))


SPANS = "c AS (SELECT conv_id AS table_id, turn // 4 AS row_ix, turn % 4 AS cell_ix, 1 + turn % 3 AS grid_span FROM conversations), k AS (SELECT table_id, max(n) AS n_columns FROM (SELECT table_id, row_ix, sum(grid_span) AS n FROM c GROUP BY 1, 2) GROUP BY 1)"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("table_id"), F.floor(t / 4).alias("row_ix"), (t % 4).alias("cell_ix"), (1 + t % 3).alias("grid_span"))


@query(f"WITH {SPANS} SELECT table_id, CAST(n_columns AS BIGINT) AS n_columns FROM k")
def table_columns(spark: SparkSession, sf: str) -> DataFrame:
    return layout.column_counts(_cells(spark, sf))


@query(f"""WITH {SPANS}, b AS (SELECT *, coalesce(sum(grid_span) OVER (PARTITION BY table_id, row_ix ORDER BY cell_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT table_id, row_ix, cell_ix, round(48 + before * (499.0::DOUBLE / n_columns), 6) AS x, CAST(floor(greatest(10, (499.0::DOUBLE / n_columns) * grid_span - 8)) AS BIGINT) AS width FROM b JOIN k USING (table_id)""")
def table_x_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return layout.cell_places(_cells(spark, sf)).select("table_id", "row_ix", "cell_ix", F.round("x", 6).alias("x"), F.col("width").cast("long").alias("width"))


@query("""WITH RECURSIVE a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
f AS (SELECT doc_id, 0 AS ord, 1 AS page_no, 48::DOUBLE AS y, 12.5 * greatest(1, ceil(length(a[1]) / 90.0)) AS h, CASE WHEN trim(a[1]) = '' THEN 0 ELSE 8 END AS g, a FROM a
UNION ALL SELECT doc_id, ord + 1, page_no + CASE WHEN yn + hn > 794 THEN 1 ELSE 0 END, CASE WHEN yn + hn > 794 THEN 48::DOUBLE ELSE yn END, hn, CASE WHEN trim(a[ord + 2]) = '' THEN 0 ELSE 8 END, a
FROM (SELECT *, CASE WHEN ord = 0 AND 48 + h > 794 THEN 48 + h + g ELSE y + h + g END AS yn, 12.5 * greatest(1, ceil(length(a[ord + 2]) / 90.0)) AS hn FROM f WHERE ord + 1 < len(a)))
SELECT doc_id, CAST(ord AS BIGINT) AS ord, CAST(page_no + CASE WHEN over THEN 1 ELSE 0 END AS BIGINT) AS page_no, y FROM (SELECT doc_id, ord, page_no, y, max(CASE WHEN ord = 0 AND 48 + h > 794 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) = 1 AS over FROM f)""")
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    height = 12.5 * F.greatest(F.lit(1), F.ceil(F.length("text") / 90.0))
    blocks = rows.select("doc_id", "ord", height.cast("double").alias("height"), F.when(F.trim("text") == "", 0.0).otherwise(8.0).alias("gap"))
    return layout.paginate(blocks).select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("page_no").cast("long").alias("page_no"), "y")


IMAGES = "i AS (SELECT p_partkey, CAST(1 + p_partkey * 37 % 40000 AS BIGINT) AS w, CAST(1 + p_partkey * 101 % 9000 AS BIGINT) AS h FROM part)"


def _images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", (1 + k * 37 % 40000).cast("int").alias("width"), (1 + k * 101 % 9000).cast("int").alias("height"))


@query(f"""WITH {IMAGES}, s AS (SELECT *, least(1.0::DOUBLE, 14400.0::DOUBLE / greatest(w * 0.75::DOUBLE, h * 0.75::DOUBLE)) AS f FROM i)
SELECT p_partkey, CAST(floor(greatest(w * 0.75::DOUBLE * f, 1) + 0.5) AS BIGINT) AS page_w, CAST(floor(greatest(h * 0.75::DOUBLE * f, 1) + 0.5) AS BIGINT) AS page_h FROM s""")
def img_page_size(spark: SparkSession, sf: str) -> DataFrame:
    w, h = layout.image_page(F.col("width").cast("double"), F.col("height").cast("double"))
    return _images(spark, sf).select("p_partkey", w.alias("page_w"), h.alias("page_h"))


@query(f"""WITH {IMAGES}, r AS (SELECT *, greatest(1, 12582912 // (w * 4)) AS t FROM i), e AS (SELECT *, unnest(range(0, h, t)) AS top FROM r)
SELECT p_partkey, CAST(top AS BIGINT) AS top, CAST(least(t, h - top) AS BIGINT) AS n_rows, w * h * 4 <= 33554432 AS direct FROM e""")
def tile_plan(spark: SparkSession, sf: str) -> DataFrame:
    direct = layout.decodes_directly(F.col("width"), F.col("height"), 128)
    return layout.tiles(_images(spark, sf)).select("p_partkey", F.col("top").cast("long").alias("top"), F.col("rows").cast("long").alias("n_rows"), direct.alias("direct"))


@query(f"""WITH {IMAGES}, p AS (SELECT CAST(1 << k AS BIGINT) AS s FROM (SELECT unnest(range(0, 31)) AS k))
SELECT p_partkey, (SELECT min(s) FROM p WHERE (w // 2) // s < 499) AS decode, (SELECT min(s) FROM p WHERE w // (2 * s) < 200) AS thumb FROM i""")
def sample_size(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).select("p_partkey", layout.sample_size(F.col("width"), F.lit(499)).alias("decode"), layout.thumbnail_sample(F.col("width")).alias("thumb"))


@query("""WITH p AS (SELECT p_partkey AS item_id, scale_step, quality, (p_partkey * 7919 % 5000000 + 2000) * (quality + 3) // (100 * (scale_step + 1)) AS size_bytes
FROM part, (SELECT unnest(range(0, 13)) AS scale_step), (SELECT unnest(range(2, 98)) AS quality)),
x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY size_bytes > 20000, CASE WHEN size_bytes <= 20000 THEN scale_step ELSE size_bytes END, CASE WHEN size_bytes <= 20000 THEN -quality ELSE scale_step END, quality) AS k FROM p)
SELECT item_id, scale_step, quality, size_bytes, size_bytes <= 20000 AS reached FROM x WHERE k = 1""")
def quality_search(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(search.IMAGE_STEPS).cast("long"))).alias("scale_step"))
    p = p.withColumn("quality", F.explode(F.sequence(F.lit(search.LOW).cast("long"), F.lit(search.HIGH).cast("long"))))
    size = F.expr("(item_id * 7919 % 5000000 + 2000) * (quality + 3) div (100 * (scale_step + 1))")
    return search.best_quality(p.withColumn("size_bytes", size), 20000)


@query("""WITH a AS (SELECT p_partkey AS doc_id, step, (p_partkey * 7919 % 900000 + 1000) // (step * step) AS size_bytes FROM part, (SELECT unnest(range(1, 12)) AS step)),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size_bytes > 20000, CASE WHEN size_bytes <= 20000 THEN step ELSE -step END) AS k FROM a)
SELECT doc_id, step, size_bytes, size_bytes <= 20000 AS reached FROM x WHERE k = 1""")
def pdf_downscale_pick(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(search.DOCUMENT_STEPS).cast("long"))).alias("step"))
    return search.first_fit(a.withColumn("size_bytes", F.expr("(doc_id * 7919 % 900000 + 1000) div (step * step)")), 20000)


@query("""WITH s AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS p, count(*) OVER (PARTITION BY n_regionkey) - 1 AS last FROM nation),
u AS (SELECT *, CASE WHEN p = 2 AND last >= 2 THEN 1 WHEN p = 1 AND last >= 2 THEN 2 ELSE p END AS a FROM s),
d AS (SELECT *, CASE WHEN a = 0 AND last >= 1 THEN 1 WHEN a = 1 AND last >= 1 THEN 0 ELSE a END AS b FROM u)
SELECT n_regionkey, n_name, CAST(CASE WHEN b > 3 THEN b - 1 ELSE b END AS INTEGER) AS position FROM d WHERE b <> 3""")
def reorder_swap(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "nation").select("n_regionkey", "n_name", (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")) - 1).alias("position"))
    return ordered.remove_at(ordered.move(ordered.move(s, ["n_regionkey"], 2, True), ["n_regionkey"], 0, False), 3)


@query(f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ' ' ELSE role END AS author, text FROM conversations),
x AS (SELECT conv_id, turn, '<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">' || {ESCAPED.format("CASE WHEN author IS NULL OR trim(author) = '' THEN 'Unknown' ELSE author END")} || ': </w:t></w:r><w:r><w:t xml:space="preserve">' || {ESCAPED.format("coalesce(text, '')")} || '</w:t></w:r></w:p>' AS v FROM c)
SELECT conv_id, count(*) AS n, md5(string_agg(v, '' ORDER BY turn, v)) AS digest FROM x GROUP BY 1""")
def comment_section(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.comment_xml(F.when(F.col("turn") % 5 == 4, " ").otherwise(F.col("role")), F.coalesce("text", F.lit(""))).alias("v"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.md5(ordered.joined(F.col("turn"), F.col("v"))).alias("digest"))


TURNS = """t AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS k, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n,
replace(replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS clean FROM conversations)"""


def conversation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each conversation: a paragraph for each turn, then a table of roles and texts."""
    k = F.col("k")
    t = table(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    t = t.select(F.col("conv_id").cast("string").alias("path"), "role", "text", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("k"))

    def runs(text, bold):
        off = F.lit(False)
        names = ("italic", "underline", "strikethrough", "is_insertion", "is_deletion")
        return F.array(F.struct(text.alias("text"), bold.alias("bold"), *(off.alias(x) for x in names), F.lit(None).cast("string").alias("color_hex")))

    block, style = F.lit("block").alias("entity"), F.element_at(F.array(*(F.lit(x) for x in T.POINTS)), k % 5 + 1)
    own = t.select("path", block, k.cast("long").alias("id"), k.alias("ord"), F.lit("PARAGRAPH").alias("kind"), style.alias("style"), (k % 3).alias("list_level"), runs(F.col("text"), F.col("role") == "user").alias("runs"))
    whole = t.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n_rows"))
    grid = whole.select("path", block, F.lit(-1).cast("long").alias("id"), F.col("n_rows").alias("ord"), F.lit("TABLE").alias("kind"), "n_rows")
    sides = t.select("*", F.posexplode(F.array(F.coalesce("role", F.lit("")), F.col("text"))).alias("j", "v")).withColumn("cell", (2 * k + F.col("j")).cast("long"))
    cell = sides.select("path", F.lit("cell").alias("entity"), F.col("cell").alias("id"), F.lit(-1).cast("long").alias("parent"), k.alias("row_ix"), F.col("j").alias("cell_ix"), (1 + k % 2).alias("grid_span"), (k % 3 == 2).alias("vmerge_cont"))
    inner = sides.select("path", block, (-2 - F.col("cell")).alias("id"), F.col("cell").alias("parent"), F.lit(0).alias("ord"), F.lit("PARAGRAPH").alias("kind"), F.lit("NORMAL").alias("style"), F.lit(0).alias("list_level"), runs(F.col("v"), F.lit(False)).alias("runs"))
    out = spark.createDataFrame([], docx.SCHEMA)
    for part in (own, grid, cell, inner):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


@query(f"""WITH {TURNS} SELECT CAST(conv_id AS VARCHAR) AS path, k AS ord, 'PARAGRAPH' AS kind, ['TITLE', 'HEADING1', 'HEADING2', 'HEADING3', 'NORMAL'][k % 5 + 1] AS style, 0 AS list_level,
CAST((k % 3 >= 1)::INT + (clean <> '')::INT AS INTEGER) AS n_runs, CASE WHEN k % 3 >= 1 THEN repeat('    ', k % 3 - 1) || '• ' ELSE '' END || clean AS text,
coalesce(role = 'user', false) AND clean <> '' AS bold, CAST(NULL AS INTEGER) AS n_rows FROM t
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), n, 'TABLE', NULL, NULL, NULL, NULL, NULL, n FROM t
UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), n + 1, 'PARAGRAPH', 'NORMAL', 0, 0, '', false, NULL FROM t""")
def docx_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Archives written and scanned again: the blocks of their bodies."""
    b = docx.blocks(docx.scan(docx_writer.write(conversation_rows(spark, sf)))).where("parent_cell_id IS NULL")
    text = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    n_runs = F.when(F.col("runs").isNotNull(), F.size("runs"))
    return b.select("path", "ord", "kind", "style", "list_level", n_runs.alias("n_runs"), text.alias("text"), F.exists("runs", lambda r: r["bold"]).alias("bold"), "n_rows")


@query(f"""WITH {TURNS}, c AS (SELECT *, unnest([0, 1]) AS j FROM t)
SELECT CAST(conv_id AS VARCHAR) AS path, k AS row_ix, CAST(j AS INTEGER) AS cell_ix, 1 + k % 2 AS grid_span, k % 3 = 2 AS vmerge_cont, CASE j WHEN 0 THEN coalesce(role, '') ELSE clean END AS text FROM c""")
def docx_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Archives written and scanned again: the cells of their tables, with the text of the paragraphs in them."""
    rows = docx.scan(docx_writer.write(conversation_rows(spark, sf))).where("entity = 'cell' OR parent IS NOT NULL")
    cell = F.when(F.col("entity") == "cell", F.col("id")).otherwise(F.col("parent"))
    at = lambda c: F.max(F.when(F.col("entity") == "cell", F.col(c))).alias(c)
    text = F.array_sort(F.collect_list(F.when(F.col("entity") == "block", F.struct("ord", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("v")))))
    found = rows.groupBy("path", cell.alias("cell")).agg(at("row_ix"), at("cell_ix"), at("grid_span"), at("vmerge_cont"), text.alias("p"))
    return found.select("path", "row_ix", "cell_ix", "grid_span", "vmerge_cont", ordered.flattened_cell(F.transform("p", lambda s: s["v"])).alias("text"))


ITEMS = "i AS (SELECT p_partkey AS k FROM part)"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"))


@query(f"""WITH {IMAGES}, r AS (SELECT *, CAST(p_partkey % 4 * 90 AS INTEGER) AS rotation FROM i)
SELECT p_partkey, CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS shown_w, CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS shown_h FROM r""")
def displayed_size(spark: SparkSession, sf: str) -> DataFrame:
    w, h = layout.displayed_size(F.col("width").cast("long"), F.col("height").cast("long"), F.col("p_partkey") % 4 * 90)
    return _images(spark, sf).select("p_partkey", w.alias("shown_w"), h.alias("shown_h"))


@query(f"""WITH {IMAGES}, r AS (SELECT *, p_partkey % 4 AS q, CASE WHEN p_partkey % 2 = 1 THEN h ELSE w END AS dw, CASE WHEN p_partkey % 2 = 1 THEN w ELSE h END AS dh FROM i),
s AS (SELECT *, 400.0::DOUBLE / dw AS sx, 300.0::DOUBLE / dh AS sy FROM r)
SELECT p_partkey, round(([1, 0, -1, 0])[q + 1] * sx, 9) + 0 AS a, round(([0, -1, 0, 1])[q + 1] * sx, 9) + 0 AS b, round(([0, h, w, 0])[q + 1] * sx + 20, 6) AS c,
round(([0, 1, 0, -1])[q + 1] * sy, 9) + 0 AS d, round(([1, 0, -1, 0])[q + 1] * sy, 9) + 0 AS e, round(([0, 0, h, w])[q + 1] * sy + 10, 6) AS f FROM s""")
def image_placement(spark: SparkSession, sf: str) -> DataFrame:
    m = layout.placement(F.col("width").cast("double"), F.col("height").cast("double"), F.col("p_partkey") % 4 * 90, (F.lit(20.0), F.lit(10.0), F.lit(400.0), F.lit(300.0)))
    return _images(spark, sf).select("p_partkey", *((F.round(v, 6 if k in "cf" else 9) + 0.0).alias(k) for k, v in m.items()))


@query(f"""WITH {IMAGES}, s AS (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE w END AS v FROM i), f AS (SELECT *, least(1.0::DOUBLE, 499.0::DOUBLE / v) AS z FROM s WHERE v > 0)
SELECT p_partkey, round(v * z, 6) AS draw_w, round(h * z, 6) AS draw_h FROM f""")
def image_boxes(spark: SparkSession, sf: str) -> DataFrame:
    w, h = layout.image_box(F.when(F.col("p_partkey") % 10 == 0, 0).otherwise(F.col("width")), F.col("height"))
    return _images(spark, sf).select("p_partkey", F.round(w, 6).alias("draw_w"), F.round(h, 6).alias("draw_h")).where("draw_w IS NOT NULL")


@query(f"""WITH {IMAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS page_no, least(1.0::DOUBLE, 14400.0::DOUBLE / greatest(w * 0.75::DOUBLE, h * 0.75::DOUBLE)) AS f FROM i)
SELECT p_partkey % 50 AS album, page_no, p_partkey, CAST(floor(greatest(w * 0.75::DOUBLE * f, 1) + 0.5) AS BIGINT) AS page_w, CAST(floor(greatest(h * 0.75::DOUBLE * f, 1) + 0.5) AS BIGINT) AS page_h FROM n""")
def image_pages(spark: SparkSession, sf: str) -> DataFrame:
    made = layout.image_pages(_images(spark, sf).withColumn("album", F.col("p_partkey") % 50), "album", "p_partkey")
    return made.select("album", F.col("page_no").cast("long").alias("page_no"), "p_partkey", "page_w", "page_h")


@query("""WITH c AS (SELECT conv_id AS table_id, turn // 4 AS row_ix, CASE WHEN turn % 4 < 3 THEN 12.5::DOUBLE * ceil(length(text) / 90.0) END AS height FROM conversations)
SELECT table_id, row_ix, greatest(18.0::DOUBLE, coalesce(max(height), 0) + 8) AS height FROM c GROUP BY 1, 2""")
def row_heights(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("table_id"), F.floor(F.col("turn") / 4).alias("row_ix"), F.when(F.col("turn") % 4 < 3, 12.5 * F.ceil(F.length("text") / 90.0)).alias("height"))
    return layout.row_heights(c)


@query(f"""WITH RECURSIVE {ITEMS}, s AS (SELECT k, list_transform(range(0, 98), lambda q: (k * 7919 % 50000 + 2000) * (q + 3) // 100 + (q * k % 17) * 300) AS sizes FROM i),
b AS (SELECT k, sizes, 3 AS lo, 97 AS hi, 2 AS best, 0 AS n FROM s WHERE sizes[3] <= 12000
UNION ALL SELECT k, sizes, CASE WHEN sizes[mid + 1] <= 12000 THEN mid + 1 ELSE lo END, CASE WHEN sizes[mid + 1] <= 12000 THEN hi ELSE mid - 1 END, CASE WHEN sizes[mid + 1] <= 12000 THEN mid ELSE best END, n + 1
FROM (SELECT *, (lo + hi) // 2 AS mid FROM b WHERE lo <= hi AND n < 8))
SELECT k, CAST(best AS INTEGER) AS quality FROM (SELECT k, best, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS r FROM b) WHERE r = 1 UNION ALL SELECT k, NULL FROM s WHERE sizes[3] > 12000""")
def replayed_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The bisection on sizes that also fall as quality rises."""
    sizes = F.expr("transform(sequence(1, 97), q -> (k * 7919 % 50000 + 2000) * (q + 3) div 100 + (q * k % 17) * 300)")
    return _items(spark, sf).select("k", search.replayed_quality(sizes, F.lit(12000)).alias("quality"))


@query(f"""WITH RECURSIVE {ITEMS}, s AS (SELECT k, CAST(k * 7919 % 900000 + 1000 AS DOUBLE) AS base FROM i),
b AS (SELECT k, base, CAST(0.05 AS FLOAT) AS lo, CAST(0.92 AS FLOAT) AS hi, 0 AS n FROM s WHERE floor(base * CAST(CAST(0.05 AS FLOAT) AS DOUBLE)) <= 100000
UNION ALL SELECT k, base, CASE WHEN fits THEN mid ELSE lo END, CASE WHEN fits THEN hi ELSE mid END, n + 1
FROM (SELECT *, floor(base * CAST(mid AS DOUBLE)) <= 100000 AS fits FROM (SELECT *, CAST((lo + hi) * CAST(0.5 AS FLOAT) AS FLOAT) AS mid FROM b WHERE n < 5)))
SELECT k, CAST(lo AS DOUBLE) AS quality FROM b WHERE n = 5""")
def document_quality(spark: SparkSession, sf: str) -> DataFrame:
    found = search.document_quality(lambda q: F.floor((F.col("k") * 7919 % 900000 + 1000).cast("double") * q.cast("double")), F.lit(100000))
    return _items(spark, sf).select("k", found.cast("double").alias("quality")).where("quality IS NOT NULL")


@query(f"""WITH RECURSIVE {IMAGES}, s AS (SELECT p_partkey, 0 AS step, w FROM i UNION ALL SELECT p_partkey, step + 1, greatest(1, CAST(floor(w * 0.85::DOUBLE) AS BIGINT)) FROM s WHERE step < 12) SELECT p_partkey, CAST(step AS INTEGER) AS step, w FROM s""")
def shrunk_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _images(spark, sf).select("p_partkey", "width", F.explode(F.sequence(F.lit(0), F.lit(search.IMAGE_STEPS))).alias("step")).select("p_partkey", "step", search.shrunk(F.col("width"), F.col("step")).alias("w"))


@query("""WITH s AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_size || ' KB' WHEN 1 THEN '' ELSE p_size || 'x' END AS given, p_partkey % 3 = 0 AS preset, p_partkey % 7 AS chosen, p_partkey % 5 AS pages FROM part),
t AS (SELECT *, CASE WHEN preset THEN 102400 WHEN k % 4 = 0 THEN CAST(regexp_extract(given, '[0-9]+') AS BIGINT) * 1024 END AS target FROM s)
SELECT k, target, CASE WHEN chosen < 1 THEN 'nothing selected' WHEN coalesce(target, 0) < 1 THEN 'no valid target' WHEN pages < 1 THEN 'no pages' END AS error FROM t""")
def size_target(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("k"), F.col("p_size").cast("string")
    given = F.when(k % 4 == 0, F.concat(n, F.lit(" KB"))).when(k % 4 == 1, "").otherwise(F.concat(n, F.lit("x")))
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size").withColumn("target", search.target_size(given, k % 3 == 0))
    return t.select("k", "target", search.guard(k % 7, F.col("target"), k % 5).alias("error"))


@query("""SELECT p_partkey, p_size || ' KB' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Target not reached: 9 KB' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Transparent areas became white.' ELSE '' END AS message FROM part""")
def result_message(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k, search.result_message(F.concat(F.col("p_size").cast("string"), F.lit(" KB")), F.lit("9 KB"), k % 2 != 0, k % 3 == 0).alias("message"))


HEADS = ("89504E470D0A1A0A", "89504E", "FFD8FF", "FFD8", "474946383961", "4749", "424D", "", "00112233445566778899")


@query(f"""WITH h AS (SELECT p_partkey, ({list(HEADS)})[1 + p_partkey % {len(HEADS)}] AS x FROM part),
t AS (SELECT *, CASE WHEN starts_with(x, '8950') AND length(x) >= 16 THEN 'png' WHEN starts_with(x, 'FFD8') AND length(x) >= 6 THEN 'jpeg' WHEN starts_with(x, '4749') AND length(x) >= 12 THEN 'gif' WHEN starts_with(x, '424D') THEN 'bmp' ELSE 'png' END AS kind FROM h)
SELECT p_partkey, kind, 'image/' || kind AS mime FROM t""")
def image_type(spark: SparkSession, sf: str) -> DataFrame:
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (1 + F.col("p_partkey") % len(HEADS)).cast("int")))
    return table(spark, sf, "part").select("p_partkey", T.image_type(head).alias("kind")).withColumn("mime", T.mime_type(F.col("kind")))


VALUES = ("aBc123", "auto", "12345", "0", "false", "true", "17", "-4", "99999999999", "x7")


@query(f"""WITH v AS (SELECT p_partkey, ({list(VALUES)})[1 + p_partkey % {len(VALUES)}] AS v FROM part)
SELECT p_partkey, regexp_full_match(v, '[0-9A-Fa-f]{{6}}') AS colour, CASE WHEN p_partkey % 3 = 0 THEN false ELSE v NOT IN ('false', '0') END AS flagged, coalesce(TRY_CAST(v AS INTEGER), 5) AS number FROM v""")
def typed_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.element_at(F.array(*map(F.lit, VALUES)), (1 + F.col("p_partkey") % len(VALUES)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.is_colour(v).alias("colour"), T.flag(F.col("p_partkey") % 3 != 0, v).alias("flagged"), T.int_or(v, 5).alias("number"))


@query("""WITH w AS (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS n, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations)
SELECT conv_id, k, role, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop FROM w WHERE n > 0""")
def span_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    runs = table(spark, sf, "conversations").select("conv_id", k.alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return ordered.span_table(runs, "conv_id", "k").select("conv_id", "k", "role", "start", "stop")


@query(f"""WITH {LINES}, g AS (SELECT *, length(text) - length(ltrim(text, ' ')) AS lead, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n, list_filter(string_split(text, ' '), lambda x: x <> '') AS words FROM l)
SELECT doc_id, page_ix, CAST(row_number() OVER (PARTITION BY doc_id, page_ix ORDER BY line_ix) - 1 AS BIGINT) AS line_ix, md5(array_to_string(words, '')) AS digest, CAST(7 AS BIGINT) AS x, CAST(list_max(list_transform(words, lambda w: 8 + length(w) % 9)) AS DOUBLE) AS font FROM g""")
def glyph_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Words as glyphs: lines are put together and numbered anew from their places."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    g = own_lines(spark, sf).select("doc_id", "page_ix", "line_ix", F.posexplode(words).alias("ord", "text"))
    g = g.select("*", (7 * (F.col("ord") + 1)).cast("long").alias("x"), (F.col("line_ix") * 14).alias("y"), (8 + F.length("text") % 9).alias("size"))
    r = lines.in_reading_order(lines.glyph_lines(g))
    return r.select("doc_id", F.col("page_ix").cast("long").alias("page_ix"), F.col("line_ix").cast("long").alias("line_ix"), F.md5("text").alias("digest"), "x", F.col("font_pt").cast("double").alias("font"))


@query("""WITH n AS (SELECT doc_id, (len(string_split(coalesce(text, ''), chr(10))) - 1) // 40 + 1 AS n_pages, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 5 END AS image_count FROM documents)
SELECT doc_id, CAST(n_pages AS BIGINT) AS n_pages, CAST(image_count AS BIGINT) AS image_count, image_count > 0 AS recompressed FROM n""")
def page_and_slot_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = lines.page_counts(own_pages(spark, sf))
    n = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 5).cast("int")
    slots = table(spark, sf, "documents").select("doc_id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("slot"))
    return search.slot_counts(counts, slots)


@query("SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) GROUP BY 1")
def first_row(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.first_row(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])


@query("""WITH RECURSIVE a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
b AS (SELECT doc_id, unnest(range(len(t) + 3)) AS ord, unnest(list_concat(t, ['#', 'first remark', 'second remark'])) AS v, len(t) AS n FROM a),
k AS (SELECT *, CASE WHEN ord = n THEN 'COMMENTS' WHEN ord > n THEN 'COMMENT' WHEN ord % 9 = 4 THEN 'IMAGE' WHEN ord % 9 IN (6, 7) THEN 'ROW' WHEN ord % 9 = 8 THEN 'END' ELSE 'PARAGRAPH' END AS kind, 12.5::DOUBLE * greatest(1, ceil(length(v) / 90.0)) AS h FROM b),
x AS (SELECT doc_id, ord, kind, CASE WHEN kind = 'IMAGE' THEN CASE WHEN ord % 18 = 4 THEN NULL ELSE (40 + ord % 50 * 20)::DOUBLE * least(1.0::DOUBLE, 499.0::DOUBLE / (30 + ord % 70 * 15)) END WHEN kind = 'ROW' THEN greatest(18, h + 8) WHEN kind = 'END' THEN 0 WHEN kind = 'PARAGRAPH' AND trim(v) = '' THEN 12.65::DOUBLE ELSE h END AS h,
CASE WHEN kind = 'ROW' OR kind = 'PARAGRAPH' AND trim(v) = '' THEN 0 WHEN kind = 'COMMENTS' THEN 16 ELSE 8 END AS g FROM k),
l AS (SELECT doc_id, list(struct_pack(o := ord, k := kind, h := h, g := g) ORDER BY ord) AS s FROM x WHERE h IS NOT NULL GROUP BY 1),
f AS (SELECT doc_id, s, 1 AS pos, 1 AS page_no, 48::DOUBLE AS y, false AS done FROM l
UNION ALL SELECT doc_id, s, pos + 1, page_no + p, CASE WHEN p > 0 THEN 48 + s[pos].h + s[pos].g ELSE y + s[pos].h + s[pos].g END, pos = len(s) FROM (SELECT *, CASE WHEN s[pos].k = 'COMMENTS' THEN 1 WHEN y + s[pos].h > 794 THEN 1 ELSE 0 END AS p FROM f WHERE NOT done))
SELECT doc_id, CAST(s[pos].o AS BIGINT) AS ord, s[pos].k AS kind, round(s[pos].h, 6) AS height, CAST(page_no + p AS BIGINT) AS page_no, round(CASE WHEN p > 0 THEN 48 ELSE y END, 6) AS y
FROM (SELECT *, CASE WHEN s[pos].k = 'COMMENTS' THEN 1 WHEN y + s[pos].h > 794 THEN 1 ELSE 0 END AS p FROM f WHERE NOT done) WHERE s[pos].k <> 'END'""")
def docx_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents on pages: paragraphs, blank ones, images, table rows, and comments on a new page."""
    text = F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.lit("#"), F.lit("first remark"), F.lit("second remark")))
    texts = table(spark, sf, "documents").select("doc_id", text.alias("t")).select("doc_id", "t", (F.size("t") - 3).alias("n"))
    rows = texts.select("doc_id", "n", F.posexplode("t").alias("ord", "v"))  # n before the lines: else the text would be split again for each
    ord_, n = F.col("ord"), F.col("n")
    kind = F.when(ord_ == n, "COMMENTS").when(ord_ > n, "COMMENT").when(ord_ % 9 == 4, "IMAGE").when((ord_ % 9).isin(6, 7), "ROW").when(ord_ % 9 == 8, "END").otherwise("PARAGRAPH")
    height = 12.5 * F.greatest(F.lit(1), F.ceil(F.length("v") / 90.0))
    width_px = F.when(ord_ % 18 == 4, 0).otherwise(30 + ord_ % 70 * 15)
    blocks = rows.select("doc_id", "ord", kind.alias("kind"), height.alias("height"), (F.trim("v") == "").alias("blank"), width_px.alias("width_px"), (40 + ord_ % 50 * 20).alias("height_px"))
    return layout.layout(blocks).select("doc_id", F.col("ord").cast("long").alias("ord"), "kind", F.round("height", 6).alias("height"), F.col("page_no").cast("long").alias("page_no"), F.round("y", 6).alias("y"))


@query(f"""WITH {RUNS}, p AS (SELECT doc_id, unnest(range((len(a) - 1) // 40 + 1)) AS page_ix FROM l0), u AS (SELECT doc_id, page_ix, sum(length(text)) AS n FROM l GROUP BY 1, 2), good AS (SELECT doc_id, page_ix FROM u WHERE n >= 20),
b AS (SELECT q.* FROM q JOIN good USING (doc_id, page_ix)),
s AS (SELECT doc_id, {STYLE} AS style FROM b JOIN m USING (doc_id) WHERE run_id IS NULL),
t AS (SELECT doc_id, page_ix, run_id, count(*) AS n_rows, sum(n_cells) AS n_cells FROM b WHERE run_id IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT doc_id, 'PARAGRAPH' AS kind, style, count(*) AS n, 0 AS n_cells FROM s GROUP BY 1, 3
UNION ALL SELECT doc_id, 'TABLE', '-', sum(n_rows), sum(n_cells) FROM t GROUP BY 1
UNION ALL SELECT doc_id, 'EMPTY', 'NORMAL', sum(n), 0 FROM (SELECT doc_id, count(*) - 1 AS n FROM p GROUP BY 1 UNION ALL SELECT doc_id, count(*) FROM t GROUP BY 1) GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS path, kind, style, CAST(n AS BIGINT) AS n, CAST(n_cells AS BIGINT) AS n_cells FROM x WHERE n > 0""")
def lines_to_docx(spark: SparkSession, sf: str) -> DataFrame:
    """Lines become documents, which are scanned again: paragraphs by style, table rows and cells, empty paragraphs."""
    rows = docx.scan(compose.lines_to_docx(cell_lines(spark, sf), own_pages(spark, sf), table(spark, sf, "documents")))
    block = F.col("entity") == "block"
    seen = rows.where("entity = 'cell' OR entity = 'block' AND parent IS NULL")  # blocks and cells at once: the archives are made and read once
    kind = F.when(~block | (F.col("kind") == "TABLE"), "TABLE").when(F.size("runs") > 0, "PARAGRAPH").otherwise("EMPTY")
    own = seen.select("path", kind.alias("kind"), F.when(kind == "TABLE", "-").otherwise(F.col("style")).alias("style"), F.when(block, F.coalesce("n_rows", F.lit(1))).otherwise(0).alias("n"), (~block).cast("int").alias("n_cells"))
    return own.groupBy("path", "kind", "style").agg(F.sum("n").alias("n"), F.sum("n_cells").alias("n_cells"))


PICTURE = "89504E470D0A1A0A0000000D49484452000003E80000000A0806000000"  # the header of a PNG of 1000 x 10 pixels


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    """Archives with relationships, media, tracked changes, links and a comments part, made of conversations."""
    k, e = F.col("k"), T.escape_xml(F.col("text"))
    t = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("k"))
    run = lambda tag: F.concat(F.lit(f"<w:r><w:{tag}>"), e, F.lit(f"</w:{tag}></w:r>"))
    drawn = F.concat(F.lit("<w:r><w:drawing><wp:inline><a:blip r:embed=\""), F.when(k % 8 == 3, "r1").otherwise("r9"), F.lit("\"/></wp:inline></w:drawing><w:t>"), e, F.lit("</w:t></w:r>"))
    body = F.when(k % 4 == 0, F.concat(F.lit("<w:ins>"), run("t"), F.lit("</w:ins>"))).when(k % 4 == 1, F.concat(F.lit("<w:del>"), run("delText"), F.lit("</w:del>"))).when(k % 4 == 2, F.concat(F.lit("<w:hyperlink>"), run("t"), F.lit("</w:hyperlink>"))).otherwise(drawn)
    said = F.concat(F.lit("<w:comment w:author=\""), F.when(k % 2 == 0, T.escape_xml(F.col("role"))).otherwise(" "), F.lit("\"><w:p><w:r><w:t>"), e, F.lit("</w:t></w:r></w:p></w:comment>"))
    whole = t.groupBy("path").agg(ordered.joined(k, F.concat(F.lit("<w:p>"), body, F.lit("</w:p>"))).alias("body"), ordered.joined(k, said).alias("said"))
    parts = {
        docx.DOCUMENT: F.concat(F.lit("<w:document><w:body>"), "body", F.lit("</w:body></w:document>")).cast("binary"),
        docx.COMMENTS: F.concat(F.lit("<w:comments>"), "said", F.lit("</w:comments>")).cast("binary"),
        docx.RELATIONSHIPS: F.lit('<Relationships><Relationship Id="r1" Target="media/a.png"/></Relationships>').cast("binary"),
        docx.MEDIA + "a.png": F.unhex(F.lit(PICTURE)),
    }
    return docx_writer.pack(whole.select("path", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in parts.items()))).alias("p")).select("path", "p.*"))


MARKED = f"""{TURNS}, o AS (SELECT *, CAST(conv_id AS VARCHAR) AS path, k + (k + 4) // 8 AS place FROM t)"""


@query(f"""WITH {MARKED} SELECT path, CAST(place AS INTEGER) AS ord, 'IMAGE' AS kind, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS marks, {len(PICTURE) // 2} AS n_bytes FROM o WHERE k % 8 = 3
UNION ALL SELECT path, CAST(place + CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END AS INTEGER), 'PARAGRAPH', clean, CASE WHEN clean = '' THEN '' ELSE (['inserted underline', 'deleted strike', 'underline 0563C1', ''])[k % 4 + 1] END, NULL FROM o""")
def docx_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Archives with images, tracked changes and links, scanned: their blocks, with the bytes of the image that each one refers to."""
    rows = docx.scan(_marked(spark, sf))
    b, images = docx.blocks(rows), docx.images(rows).select("path", "image_id", F.octet_length("bytes").alias("n_bytes"))
    r = F.element_at("runs", 1)
    words = F.array(F.when(r["is_insertion"], "inserted"), F.when(r["is_deletion"], "deleted"), F.when(r["underline"], "underline"), F.when(r["strikethrough"], "strike"), r["color_hex"])
    paragraph = F.col("kind") == "PARAGRAPH"
    marks = F.when(paragraph, F.when(F.size("runs") > 0, F.array_join(words, " ")).otherwise(""))
    text = F.when(paragraph, F.array_join(F.transform("runs", lambda x: x["text"]), ""))
    return b.join(images, ["path", "image_id"], "left").select("path", "ord", "kind", text.alias("text"), marks.alias("marks"), "n_bytes")


@query(f"""WITH {MARKED}, c AS (SELECT path, k, CASE WHEN k % 2 = 0 AND trim(role) <> '' THEN role ELSE 'Unknown' END AS author, regexp_replace(clean, '^\\s+|\\s+$', '', 'g') AS text FROM o)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS INTEGER) AS ix, author, text FROM c WHERE text <> ''""")
def docx_comments(spark: SparkSession, sf: str) -> DataFrame:
    """The comments part of archives, scanned."""
    return docx.comments(docx.scan(_marked(spark, sf)))


@query(f"""WITH {TURNS}, i AS (SELECT CAST(conv_id AS VARCHAR) AS path, k, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS nth FROM t WHERE k % 3 = 1)
SELECT path, CAST(nth - 1 AS BIGINT) AS image_id, CASE k % 2 WHEN 0 THEN 29 ELSE 10 END AS n_bytes, 'word/media/image' || nth || CASE k % 2 WHEN 0 THEN '.png' ELSE '.gif' END AS part,
CASE k % 2 WHEN 0 THEN 5486400 ELSE 400 * 9525 END AS cx, CASE k % 2 WHEN 0 THEN CAST(floor(95250 * (5486400.0::DOUBLE / 9525000)) AS INTEGER) ELSE 300 * 9525 END AS cy FROM i""")
def docx_images(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with images written and scanned again: bytes, part names and drawn sizes."""
    k = F.col("k")
    t = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("k")).where("k % 3 = 1")
    content = F.when(k % 2 == 0, F.unhex(F.lit(PICTURE))).otherwise(F.unhex(F.lit("47494638396100000000")))
    block = t.select("path", F.lit("block").alias("entity"), k.cast("long").alias("id"), k.alias("ord"), F.lit("IMAGE").alias("kind"), k.cast("long").alias("image_id"))
    picture = t.select("path", F.lit("image").alias("entity"), k.cast("long").alias("id"), content.alias("bytes"))
    files = docx_writer.write(spark.createDataFrame([], docx.SCHEMA).unionByName(block, allowMissingColumns=True).unionByName(picture, allowMissingColumns=True))
    drawn = files.mapInArrow(_drawings, "path string, image_id long, part string, cx int, cy int")
    return docx.images(docx.scan(files)).join(drawn, ["path", "image_id"]).select("path", "image_id", F.octet_length("bytes").alias("n_bytes"), "part", "cx", "cy")


def _drawings(batches):
    """The extent and the part of each drawing in archives (path, content)."""
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                rels = docx.relationships(z.read(docx.RELATIONSHIPS))
                drawings = docx.tree(z.read(docx.DOCUMENT)).iter("w:drawing")
                for n, d in enumerate(drawings):
                    size, blip = next(d.iter("wp:extent")), next(d.iter("a:blip"))
                    rows.append((path, n, docx.media_part(rels[blip.get("r:embed")]), int(size.get("cx")), int(size.get("cy"))))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["path", "image_id", "part", "cx", "cy"])
