"""Shards of near equal bytes by histogram sort.

Rows are sorted by a 128-bit key in hexadecimal: hash of the text, then hash of doc_id. Equal texts are neighbours, so a splitter cuts a
group of copies only if no place outside of the group meets the tolerance: a group of up to twice the tolerance (1 % of a shard) is never cut, a larger
one only where a splitter would otherwise miss its target by more than the tolerance. Each round counts, exactly and over all rows, the bytes below
candidate boundaries: first all boundaries of three digits, then finer ones only inside the cells that hold an unsettled splitter, until
each splitter is within `tolerance` of its target or the cell holds one row. Then the rows are exchanged once, by shard and key cell.

A round sends at most 4096 counts a splitter to the driver. A cell for slot numbers is a key prefix, longer in larger tables (a cell has about 100,000
rows, the broadcast counts a million rows at most), and a doc_id hash digit, so that a text that a third of all rows share (the empty one, say) is
numbered by many tasks.

Nulls: a null text has no bytes; a null doc_id has a hash of its own. Repeated rows share a key and stay together. An empty table gives no
rows; shards may stay empty when there are fewer rows than shards. Columns other than doc_id and text are ignored or carried along.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIGITS, KEY_DIGITS = 3, 32


def sort_key() -> Column:
    part = lambda c: F.lpad(F.hex(F.xxhash64(c)), 16, "0")
    return F.concat(part(common.text_or_empty()), part(F.col("doc_id")))


def splitters(rows: DataFrame, n_shards: int, tolerance: float) -> list[str]:
    """The n_shards - 1 lower bounds of shards 1, 2, ... for rows of (key, size)."""
    total, active, found, digits = 0, {"": (0, list(range(1, n_shards)))}, {}, 0
    while active:
        digits = min(KEY_DIGITS, digits + DIGITS)
        inside = rows if "" in active else rows.where(F.substring("key", 1, len(next(iter(active)))).isin(list(active)))
        cells: dict[str, list] = {}
        for r in inside.groupBy(F.substring("key", 1, digits).alias("cell")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
            cells.setdefault(next(iter(active)) and r["cell"][: len(next(iter(active)))], []).append((r["cell"], r["bytes"], r["n"]))
        if not total:
            total = sum(b for _, b, _ in cells.get("", []))
            if not total:
                return ["G"] * (n_shards - 1)
        later: dict[str, tuple[int, list[int]]] = {}
        for parent, (below, wanted) in active.items():
            own = sorted(cells[parent])
            ends = [below + x for x in accumulate(b for _, b, _ in own)]
            for k in wanted:
                target = k * total / n_shards
                i = min(bisect_left(ends, target), len(own) - 1)
                cell, size, n = own[i]
                start = ends[i] - size
                if min(target - start, ends[i] - target) <= tolerance * total / n_shards or n == 1 or digits == KEY_DIGITS:
                    found[k] = cell if target - start <= ends[i] - target else cell + "G"  # G comes after F: behind the whole cell
                else:
                    later.setdefault(cell, (start, []))[1].append(k)
        active = later
    return [found[k] for k in range(1, n_shards)]


def shard_of(key: Column, bounds: list[str]) -> Column:
    """Number of bounds at or below key, by bisection."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(bounds))


def histogram_shards(df: DataFrame, n_shards: int = 40, tolerance: float = 0.005, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns in carry."""
    text = common.text_or_empty()
    base = df.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        sort_key().alias("key"),
        *carry,
    )
    rows = base if carry else common.keep(base, "shard-keys")
    light = common.keep(rows.select("key", "size"), "shard-histogram") if carry else rows
    shard = shard_of(F.col("key"), splitters(light.select("key", "size"), n_shards, tolerance))
    wide = min(4, max(2, len(f"{light.count() // 100_000:x}") - 1))
    cell = F.concat(F.substring("key", 1, wide), F.substring("key", 17, 1))
    counts = light.groupBy(shard.alias("shard"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))  # n_shards + 16**wide prefixes, 16 digits
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "cell").orderBy("key", "doc_id", "size", "text_crc32")
    return (
        rows.withColumn("shard", shard)
        .withColumn("cell", cell)
        .withColumn("place", F.row_number().over(place))
        .join(F.broadcast(first), ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            *carry,
        )
    )


def write_shards(df: DataFrame, path: str, n_shards: int = 40) -> None:
    """Writes df's documents as one folder a shard, each sorted by slot."""
    carry = tuple(c for c in df.columns if c not in {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "key", "cell", "place"})
    histogram_shards(df, n_shards, carry=carry).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(common.documents(spark, sf_dir))
