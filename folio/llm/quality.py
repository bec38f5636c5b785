"""Quality classifier with hierarchical empirical Bayes.

* Evidence: a logistic regression on the presence of informative words and on the shares of character classes, fitted to labelled documents
  (clean: quality 1 and not toxic). The fit uses at most `max_labels` labelled documents, the first by hash of doc_id; this bound is the only
  sample. Words are chosen by a likelihood-ratio test, merged per task, at most `max_words`.
* Sites: a host (the source) has paths (source and language). Grouped aggregation of the evidence over all documents gives each site's
  mean and size. A path's posterior mean is shrunk towards its host's, the host's towards the global mean; the prior's strength is the ratio of the
  variance within sites to that between them (method of moments), so sparse sites fall back on what stands above them.
* A document's posterior log-odds are its evidence plus the log-odds by which its path differs from the global mean. It is kept at `threshold` or more.

Site totals are one row a path, made by partial aggregation, and joined back on the path; adaptive skew handling splits a hot one.

Nulls: a null text is empty, a null source or language is a site of its own, null labels are left out, and a null doc_id is scored as any
other. Without usable labels of both classes the evidence is even and all documents stay. Repeated rows get equal scores. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:'\"-()?", "!", "#%&*$@+=<>^~_/\\", "|", "[]{}`", " \t\n\r\v\f")
MEMBER = np.zeros((len(CLASSES), 256), dtype=bool)
for _k, _c in enumerate(CLASSES):
    MEMBER[_k, [ord(x) for x in _c]] = True
DENSE = len(CLASSES) + 4


def _dense(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shares of character classes, word length, share of distinct words, of the commonest word, and size of each document."""
    lo = int(offsets[0])
    d, rel = data[lo : int(offsets[-1])], offsets - lo
    n = np.diff(rel)
    out = np.zeros((len(n), DENSE))
    for k in range(len(CLASSES)):
        below = np.concatenate([[0], np.cumsum(MEMBER[k][d], dtype=np.int64)])
        out[:, k] = (below[rel[1:]] - below[rel[:-1]]) / np.maximum(n, 1)
    out[:, -4] = np.minimum(n / np.maximum(counts, 1), 30) / 10
    ends = np.cumsum(counts)
    for i, (c, e) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if c:
            own = np.sort(h[e - c : e])
            runs = np.diff(np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [c]]))
            out[i, -3], out[i, -2] = len(runs) / c, runs.max() / c
    out[:, -1] = np.log1p(counts) / 10
    return out


def _chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = textnum.column_bytes(column)
    for i, j in textnum.chunks(offsets):
        h, counts = textnum.words(data, offsets[i : j + 1])
        yield i, j, data, offsets[i : j + 1], h, counts


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, clean, n): documents of a batch that hold the word."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, _, _, h, counts in _chunks(batch.column(0)):
            doc = np.repeat(np.arange(i, j), counts)
            pair = np.unique(np.stack([doc, h.view(np.int64)]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
            for clean in (0, 1):
                word, n = np.unique(pair[1][label[pair[0]] == clean], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.full(len(word), clean)), pa.array(n)], ["word", "clean", "n"])


def _present(words: np.ndarray, h: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the chosen words that each document holds."""
    if len(words):
        at = np.minimum(np.searchsorted(words, h.view(np.int64)), len(words) - 1)
        hit = words[at] == h.view(np.int64)
    else:
        at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    ends = np.cumsum(counts)
    for c, e in zip(counts.tolist(), ends.tolist(), strict=True):
        yield np.unique(at[e - c : e][hit[e - c : e]])


def _feature_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for i, j, data, offsets, h, counts in _chunks(batch.column(0)):
                dense = _dense(data, offsets, h, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.array([x.astype("<i4").tobytes() for x in _present(words, h, counts)], pa.binary()), pa.array([x.astype("<f8").tobytes() for x in dense], pa.binary())],
                    ["clean", "words", "dense"],
                )

    return run


def _evidence(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, scale, shift, dense_weights, bias = shared.value
        for batch in batches:
            out = []
            for _, _, data, offsets, h, counts in _chunks(batch.column(1)):
                score = ((_dense(data, offsets, h, counts) - shift) / scale) @ dense_weights + bias
                out.append(score + np.array([weights[x].sum() for x in _present(words, h, counts)]))
            e = np.clip(np.concatenate([*out, np.zeros(0)]), -20, 20)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(e)], ["doc_id", "source", "lang", "evidence"])

    return run


def fit(labelled: DataFrame, max_words: int = 1024, min_documents: int = 5, steps: int = 300, ridge: float = 2e-4):
    """(words, weights, scale, shift, dense weights, bias) from rows (text, clean)."""
    spark = labelled.sparkSession
    common.ship(spark)
    sizes = {r["clean"]: r["n"] for r in labelled.groupBy("clean").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), np.ones(DENSE), np.zeros(DENSE), np.zeros(DENSE), 20.0
    counted = labelled.select("text", "clean").mapInArrow(_word_rows, "word long, clean long, n long").groupBy("word").agg(
        F.sum(F.when(F.col("clean") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("clean") == 1, F.col("n")).otherwise(0)).alias("b")
    )
    a, b = F.col("a"), F.col("b")

    def part(k: Column, n: Column | int, p: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)

    p = (a + b) / (n0 + n1)
    chosen = counted.where((a + b >= min_documents) & (a + b < n0 + n1)).withColumn("gain", part(a, n0, p) + part(b, n1, p)).orderBy(F.desc("gain"), "word").limit(max_words)
    words = np.sort(np.array([r["word"] for r in chosen.where("gain > 4").select("word").collect()], dtype=np.int64))
    shared = spark.sparkContext.broadcast(words)
    rows = labelled.select("text", "clean").mapInArrow(_feature_rows(shared), "clean long, words binary, dense binary").collect()  # max_labels rows at most
    y = np.array([r["clean"] for r in rows], dtype=np.float64)
    dense = np.stack([np.frombuffer(r["dense"], "<f8") for r in rows])
    lists = [np.frombuffer(r["words"], "<i4") for r in rows]
    order = np.lexsort((dense[:, -1], dense[:, 1], y))  # the fit does not depend on the order in which tasks ended
    y, dense, lists = y[order], dense[order], [lists[k] for k in order]
    shift, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    dense = (dense - shift) / scale
    row = np.repeat(np.arange(len(y)), [len(x) for x in lists])
    col = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int64)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)  # both classes count alike
    w, v, bias = np.zeros(len(words)), np.zeros(DENSE), 0.0
    grads = [np.zeros_like(w), np.zeros_like(v), 0.0]
    seconds = [np.zeros_like(w), np.zeros_like(v), 0.0]
    for t in range(1, steps + 1):  # Adam on the full batch
        z = dense @ v + bias + np.bincount(row, w[col], len(y))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        now = [np.bincount(col, r[row], len(words)) + ridge * w, dense.T @ r + ridge * v, r.sum()]
        for k, g in enumerate(now):
            grads[k] = 0.9 * grads[k] + 0.1 * g
            seconds[k] = 0.99 * seconds[k] + 0.01 * g * g
        move = [0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8) for m, s in zip(grads, seconds, strict=True)]
        w, v, bias = w - move[0], v - move[1], bias - move[2]
    return words, w, scale, shift, v, float(bias)




def classify(df: DataFrame, labels: DataFrame, max_labels: int = 20000, threshold: float = 0.5) -> DataFrame:
    """doc_id, source, lang, evidence, host_mean, path_mean, posterior, kept: one row for each row of df."""
    spark = df.sparkSession
    common.ship(spark)
    text = common.text_or_empty()
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("__id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("long").alias("clean"))
    sample = known.orderBy(F.xxhash64("__id"), "__id", "clean").limit(max_labels)
    rows = df.select(F.col("doc_id").alias("__id"), text.alias("text")).join(F.broadcast(sample), "__id")  # at most max_labels rows of two numbers
    model = spark.sparkContext.broadcast(fit(common.keep(rows.select("text", "clean"), "quality-labelled")))
    scored = common.keep(
        df.select("doc_id", text.alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")).mapInArrow(
            _evidence(model), "doc_id long, source string, lang string, evidence double"
        ),
        "quality-evidence",
    )
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = common.keep(scored.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("var")), "quality-sites")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("hn"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("hmean"))
    whole = hosts.agg(F.sum("hn").alias("n"), (F.sum(F.col("hn") * F.col("hmean")) / F.sum("hn")).alias("mean"), F.var_samp("hmean").alias("between"), F.avg(1 / F.col("hn")).alias("noise")).first()
    n, mean = whole["n"] or 0, min(max(whole["mean"] or 0.5, 1e-4), 1 - 1e-4)
    within = paths.agg(F.sum(F.col("var") * F.col("n")) / F.sum("n")).first()[0] or 0.0

    def strength(between: float | None, noise: float | None) -> float:
        """Prior documents a site: the variance within sites by that between them."""
        real = max((between or 0.0) - within * (noise or 0.0), 1e-6)
        return max(within, 1e-6) / real

    of_host = strength(whole["between"], whole["noise"])
    hosts = hosts.withColumn("host_mean", (F.col("hn") * F.col("hmean") + of_host * mean) / (F.col("hn") + of_host))
    hosts = hosts.withColumnRenamed("source", "__host")
    joined = paths.join(hosts, F.col("source").eqNullSafe(F.col("__host"))).select("source", "lang", "n", "mean", "hmean", "host_mean")
    apart = joined.agg(F.avg(F.pow(F.col("mean") - F.col("hmean"), 2)), F.avg(1 / F.col("n"))).first()
    of_path = strength(apart[0], apart[1])
    sites = joined.withColumn("path_mean", (F.col("n") * F.col("mean") + of_path * F.col("host_mean")) / (F.col("n") + of_path)).select(
        F.col("source").alias("__source"), F.col("lang").alias("__lang"), "host_mean", "path_mean"
    )
    logit = lambda c: F.log(c / (1 - c))
    site = logit(F.least(F.greatest("path_mean", F.lit(1e-4)), F.lit(1 - 1e-4))) - float(np.log(mean / (1 - mean)))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + site)))
    met = scored.join(sites, F.col("source").eqNullSafe(F.col("__source")) & F.col("lang").eqNullSafe(F.col("__lang")))
    return met.select("doc_id", "source", "lang", "evidence", "host_mean", "path_mean", posterior.alias("posterior"), (posterior >= threshold).alias("kept"))


def keep_clean(df: DataFrame, labels: DataFrame, max_labels: int = 20000, threshold: float = 0.5) -> DataFrame:
    """df's rows, all columns, whose doc_id is kept (scores depend on the text, source and language alone; rows of one doc_id go by the best)."""
    kept = classify(df, labels, max_labels, threshold).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return df.join(kept, df["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def op3_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
