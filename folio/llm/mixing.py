"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

* Targets: sources, sorted by code point with null last, weigh 5, 2, 1, repeating, and share `share` of all words; a target stops at
  `most` times its source's words and the excess is shared again by weight among the others until none is above.
* A source's documents are dealt by hash into `n_blocks` permuted blocks. Whole passes take every block; the rest of the target takes blocks in
  their permuted order, and of the last one the documents, in hash order, whose middle word lies below the target. So a source's
  words miss its target by half a document at most. This gives each source's exact quota of blocks.
* The quotas of all sources are split among the output shards by a binary tree: each node draws how many blocks of each source go to
  its left half from the multivariate hypergeometric distribution, seeded by the node. A leaf is a shard with an exact quota of each source;
  it draws that many blocks from the source's permuted sequence, disjoint from those of all other shards. mix() deals the rows out by
  these shards, one exchange, and orders each shard by hash (the local shuffle); mix_plan() names the shard of each copy.

The driver holds a number a block (n_blocks a source) and the tree's leaves. The plan, a row a block, is broadcast up to `MOST_PLAN` rows; beyond,
it is joined by source and block, so a source with a third of all rows is n_blocks keys. Everything depends on the seed and doc_id
alone, so reruns agree.

Nulls: a null text has no words, a null source is a source of its own (the last), a null doc_id has a hash. Documents without words take
part with nothing taken. Repeated rows are mixed one by one but share a block; ties of the hash are ordered by doc_id and size. Texts of any length are
counted whole. An empty table gives no rows. Other columns are carried by `mix`, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST_PLAN = 100_000  # rows, of some 60 bytes, of a plan that is broadcast


def water_fill(sizes: list[int], weights: list[int], share: Fraction, most: int) -> list[Fraction]:
    """Each source's target."""
    budget, targets, active = sum(sizes) * share, [Fraction(0)] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while active:
        unit = budget / sum(weights[i] for i in active)
        above = [i for i in active if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in active:
                targets[i] = weights[i] * unit
            break
        for i in above:
            targets[i] = Fraction(most * sizes[i])
            budget -= targets[i]
        active = [i for i in active if i not in set(above)]
    return targets


def split_tree(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: an (n_shards, sources) table whose columns sum to quotas."""
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)

    def node(lo: int, hi: int, counts: np.ndarray, name: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, name])
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else counts
        node(lo, mid, left, 2 * name)
        node(mid, hi, counts - left, 2 * name + 1)

    node(0, n_shards, quotas.astype(np.int64), 1)
    return out


def _plan(sources: list[tuple[str, int, Fraction]], blocks: dict[str, dict[int, int]], n_shards: int, seed: int) -> list[tuple]:
    """(source key, block, whole copies, words of a part or null, shard of each copy) of every block."""
    draws = []
    for i, (key, size, target) in enumerate(sources):
        own = blocks[key]
        order = [int(x) for x in np.random.default_rng([seed, 7, i]).permutation(max(own) + 1) if int(x) in own]
        passes, left = (int(target // size), target % size) if size else (0, Fraction(0))
        whole, part = dict.fromkeys(order, passes), {}
        for b in order:
            if left <= 0:
                break
            if own[b] <= left:
                whole[b] += 1
            else:
                part[b] = float(left)
            left -= min(left, own[b])
        draws.append((key, [(b, c) for c in range(passes + 1) for b in order if c < whole[b] or (c == whole[b] and b in part)], whole, part))
    table = split_tree(np.array([len(d) for _, d, _, _ in draws]), n_shards, seed) if draws else np.zeros((n_shards, 0), dtype=np.int64)
    rows = []
    for i, (key, own, whole, part) in enumerate(draws):
        shard_of: dict[int, list[int]] = {}
        for (b, _), shard in zip(own, np.repeat(np.arange(n_shards), table[:, i]), strict=True):
            shard_of.setdefault(b, []).append(int(shard))
        rows += [(key, b, n, part.get(b), shard_of.get(b, [])) for b, n in whole.items()]
    return rows


def _mixed(df: DataFrame, carry: list, seed: int, n_shards: int | None, share: str, most: int, n_blocks: int, shard_words: int) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    sized = df.select(
        F.col("doc_id").alias("__id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("__source"),  # "t" sorts behind every "s..."
        F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long").alias("__size"),
        F.xxhash64("doc_id", F.lit(seed)).alias("__hash"),
        *carry,
    ).withColumn("__block", F.pmod("__hash", F.lit(n_blocks)))
    light = common.keep(sized.drop("__carry"), "mix-sizes")
    blocks: dict[str, dict[int, int]] = {}
    for r in light.groupBy("__source", "__block").agg(F.sum("__size").alias("words")).collect():
        blocks.setdefault(r["__source"], {})[r["__block"]] = r["words"]
    totals = sorted((k, sum(own.values())) for k, own in blocks.items())
    targets = water_fill([w for _, w in totals], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))], Fraction(share), most)
    n_shards = n_shards or max(16, -(-int(sum(targets)) // shard_words))
    rows = _plan([(k, w, t) for (k, w), t in zip(totals, targets, strict=True)], blocks, n_shards, seed)
    facts = {k: (w, float(t)) for (k, w), t in zip(totals, targets, strict=True)}
    plan = spark.createDataFrame(
        [(*r, *facts[r[0]]) for r in rows], "__source string, __block long, __whole int, __part double, __shards array<int>, __source_size long, __target double"
    )
    all_rows = (sized if carry else light).join(F.broadcast(plan) if len(rows) <= MOST_PLAN else plan, ["__source", "__block"])
    before = Window.partitionBy("__source", "__block").orderBy("__hash", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    whole = all_rows.where("__part IS NULL").withColumn("__copies", F.col("__whole"))
    middle = F.coalesce(F.sum("__size").over(before), F.lit(0)) + F.col("__size") / 2
    part = all_rows.where("__part IS NOT NULL").withColumn("__copies", F.col("__whole") + (middle < F.col("__part")).cast("int"))
    return whole.unionByName(part), n_shards


def mix_plan(df: DataFrame, seed: int = 8, n_shards: int | None = None, share: str = "3/2", most: int = 2, n_blocks: int = 256, shard_words: int = 1 << 24) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, shards (of each copy): one row for each row of df. n_shards: by default one for shard_words, 16 at least."""
    m, _ = _mixed(df, [], seed, n_shards, share, most, n_blocks, shard_words)
    return m.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__copies").alias("copies"),
        F.slice("__shards", F.lit(1), F.col("__copies")).alias("shards"),
    )


def mix(df: DataFrame, seed: int = 8, n_shards: int | None = None, share: str = "3/2", most: int = 2, n_blocks: int = 256, shard_words: int = 1 << 24, shards: bool = False) -> DataFrame:
    """df's columns, a row for each copy drawn, dealt out by shard and shuffled inside; with shards also mix_shard and mix_order."""
    m, n = _mixed(df, [F.struct(*df.columns).alias("__carry")], seed, n_shards, share, most, n_blocks, shard_words)
    copies = m.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    drawn = copies.select("__carry", F.element_at("__shards", F.col("__copy")).alias("__shard"), F.xxhash64("__id", "__copy", F.lit(seed)).alias("__order"))
    dealt = drawn.repartitionById(n, "__shard").sortWithinPartitions("__order")  # a task a shard
    return dealt.select("__carry.*", *([F.col("__shard").alias("mix_shard"), F.col("__order").alias("mix_order")] if shards else []))


def op8_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(common.documents(spark, sf_dir))
