"""Secret scanning with an incremental blob ledger.

Every version of a text is addressed by its content (SHA-256 of the UTF-8 bytes). A ledger table on shared files has a row for each blob
and rule version that was scanned, with its findings, also when there are none. A run scans the distinct blobs that the ledger lacks for the current
rule version, appends them, and joins the findings back to all paths (rows) that hold the blob.

Copies merge before the shuffle, so a blob that a third of all rows hold is scanned once; the join back splits such a key by adaptive
skew handling. Positions come from split() and regexp_extract_all() with one pattern: gaps and matches alternate, so a match starts where
the lengths before it end. Matches that are too short consume their characters and are dropped afterwards, as the rules say.

Nulls: a null text is the empty blob, with no findings. Repeated rows each get the findings. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULE_VERSION = 1
#: Kind, pattern (Java and RE2), quick test. Hexadecimal runs and access keys have their lengths in the pattern: a run is matched from its
#: first character to its last, so that is the same as dropping short matches.
RULES = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    ("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
SPAN = "array<struct<start:int,rank:int,stop:int>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, test: str) -> Column:
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        good = F.length(F.regexp_extract(x["hit"], VALUE, 1)) >= 6 if kind == "assign" else F.lit(True)
        one = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("stop"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["spans"], one)).otherwise(state["spans"]).alias("spans"))

    quick = text.contains(test) if kind == "access" else text.rlike(test)
    return F.when(quick, F.aggregate(pairs, start, step, lambda s: s["spans"])).otherwise(F.array().cast(SPAN))


def scan(blobs: DataFrame) -> DataFrame:
    """blob -> rule_version, counts and span strings, from columns blob and text."""
    text = F.col("text")
    found = blobs.select("blob", *(_spans(text, i, *rule).alias(rule[0]) for i, rule in enumerate(RULES)))
    kinds = F.array(*(F.lit(r[0]) for r in RULES))
    line = F.array_join(
        F.transform(F.array_sort(F.concat(*(F.col(r[0]) for r in RULES))), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    return found.select("blob", F.lit(RULE_VERSION).alias("rule_version"), *(F.size(r[0]).cast("long").alias(f"n_{r[0]}") for r in RULES), line.alias("spans"))


LEDGER = "blob string, rule_version int, n_assign long, n_access long, n_hex long, spans string"


def update_ledger(df: DataFrame, ledger: str, exists: bool) -> DataFrame:
    """Scans the blobs of df that the ledger lacks and appends them; returns the ledger's rows of this rule version."""
    spark = df.sparkSession
    text = common.text_or_empty()
    blobs = df.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if exists:
        seen = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
        blobs = blobs.join(seen, "blob", "left_anti")
    scan(blobs).write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)


def secret_spans(df: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans. ledger: a folder kept between runs; without it a new one is begun."""
    spark = df.sparkSession
    path = ledger or common.new_path(spark, "secret-ledger")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = update_ledger(df, path, exists)
    paths = df.select("doc_id", F.sha2(common.text_or_empty(), 256).alias("blob"))
    return paths.join(known, "blob").select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(common.documents(spark, sf_dir))


def _sql_kind(rank: int, kind: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    good = "length(regexp_extract(hits[i], '" + VALUE.replace("'", "''") + "', 1)) >= 6" if kind == "assign" else "true"
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
       list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS start,
       length(hits[i]) AS n
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits
            FROM d WHERE regexp_matches(text, '{p}')))
WHERE {good}"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(_sql_kind(i, k, p) for i, (k, p, _) in enumerate(RULES))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
