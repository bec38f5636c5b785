"""Exact Jaccard similarity join on word shingles: regions around pivots, boundary replication, recursion.

The metric is d = 1 - |A & B| / |A | B|; two documents link at d <= 1 - percent / 100. Documents with equal sets (d = 0) become one class first.

Between unrelated texts d is 1 or nearly so, and document pivots alone would replicate every document into every region. So regions are made
in two levels:

* First level: the pivots are single shingles. A document's nearest such pivot is the first of its shingles in one global order. By the
  triangle inequality a partner can miss at most the first |A| - ceil(percent / 100 * |A|) shingles of A, so a document is replicated to the
  regions of that many pivots and one more: its window. Any two linked documents meet in the region of their first common shingle. The
  order puts the most frequent shingles last, so passages that many documents share make no regions of documents that differ otherwise.
* Second level: in a region of at most `small` classes, each pair whose sizes and places in the order allow a link is a candidate. A larger
  region takes one of its documents as pivot and is joined again by the members' differences from it. |A ^ B| is a metric, taking the
  difference from a pivot keeps it, and linked sets differ by at most (100 - percent) / (100 + percent) * (|A| + |B|) shingles. So members
  that are close to the pivot link by the triangle inequality alone (a star around the closest one), and any other linked pair shares a
  shingle in the windows of their differences, the least frequent ones first. Up to `leaf` members of a pivot are joined so in one task, by
  their differences alone; more than that are split into regions by the shingles in those windows and joined again, until all is done. The
  pivot leaves its region, so each round's regions are smaller.

Each class has a parity sketch (bit h is how many of its shingles fall to h, modulo 2), which grows with the set; of two sketches the longer is
folded to the length of the other. Sketches differ in no more bits than the sets differ in shingles, so pairs whose sketches differ too much are dropped, exactly. The other candidates are verified on the whole sets, each document with its first candidate first; pairs that these links join already are not held against
each other. A pivot's set travels once for up to `fan` partners (salted), so a pivot with a third of all
rows as partners is dealt to many tasks. Shingles are compared by 64-bit hashes. The frequent shingles are counted over all documents; the
`max_hot` most frequent ones are broadcast (8 bytes each): the order only moves work, any order gives the same links.

The first level's entries (shingle, document, set) are dealt out by shingle in blobs of many, so the shuffle moves and sorts few rows and a task
finds its regions by sorting numbers; equal sets stand in each region once, by their least id. A task holds one bucket of shingles at a time.

Nulls: a null text has no words, an empty set, and links with nothing. Rows with a null doc_id are not compared and keep a null component_id.
Repeated rows have one set and one component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, textnum
from .components import components

U = np.uint64
NO_ID = -(1 << 63)
ENTRY = np.dtype([("s", "<i8"), ("id", "<i8"), ("k", "<i8"), ("n", "<i4"), ("p", "<i4")])  # a shingle of a document's window: document, its set's hash and size, place
DEAL = 1 << 18  # entries dealt out at once
SKETCH = 10  # least bits of a parity sketch, as a power of two; a larger set has at least half as many bits as shingles


def needed(a, b, percent: int):
    """Least intersection of linked sets with sizes a and b."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def window(n, percent: int):
    """Shingles, from the first in the order, one of which any partner must have."""
    return n - (percent * n + 99) // 100 + 1


def set_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles."""
    return int(textnum.mix(s.view(U) + U(0x51)).sum(dtype=U).view(np.int64))


def _profiles(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, heads, bits = [], [], [], [], []
            for s in textnum.shingle_sets(b.column(1), width):
                u = s.view(U)
                n.append(len(s))
                k1.append(set_key(s))
                k2.append(int(np.bitwise_xor.reduce(textnum.mix(u * U(0x2545F4914F6CDD1D) + U(0x77))).view(np.int64)) if len(s) else 0)
                size = 1 << max(SKETCH, (len(s) - 1).bit_length() - 1)
                odd = np.bincount((textnum.mix(u ^ U(0x5DEECE66D)) & U(size - 1)).astype(np.int64), minlength=size) & 1
                bits.append(np.packbits(odd.astype(bool)).view(np.int64))
                heads.append(s[: 5 * window(len(s), percent) // 4 + 1].tobytes())
            lengths = np.concatenate([[0], np.cumsum([len(x) for x in bits])]).astype(np.int32)
            sketch = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*bits, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(heads, pa.binary()), sketch], ["doc_id", "n", "k1", "k2", "head", "sketch"])

    return run


def _blobs(rows: np.ndarray, s: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob): rows dealt out by their shingles s, those of a bucket in one value. So a shuffle moves few rows, and tasks sort numbers in place."""
    for k in range(0, len(rows), DEAL):
        where = (s[k : k + DEAL].view(U) % U(buckets)).astype(np.uint16)
        order = np.argsort(where, kind="stable")
        own, part = where[order], np.ascontiguousarray(rows[k : k + DEAL][order])
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        blobs = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * rows.itemsize).astype(np.int32)), pa.py_buffer(part.view(np.uint8))])
        yield pa.RecordBatch.from_arrays([pa.array(own[at[:-1]].astype(np.int32)), blobs], ["bucket", "blob"])


def _of_buckets(dtype, work):
    """work(rows of a bucket) for each bucket, from (bucket, blob) sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and bucket != last:
                    yield from work(np.concatenate(held))
                    held = []
                last = bucket
                held.append(np.frombuffer(blob.as_py(), dtype))
        if held:
            yield from work(np.concatenate(held))

    return run


def _head_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = textnum.column_bytes(batch.column(0))
            s = s[0][int(s[1][0]) : int(s[1][-1])].view(np.int64)
            yield from _blobs(s, s, buckets)

    return run


def _often(hot_from: int):
    """Shingles with hot_from rows or more, and how many."""

    def work(s: np.ndarray) -> Iterator[pa.RecordBatch]:
        s = np.sort(s)
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        count = np.diff(np.concatenate([at, [len(s)]]))
        yield pa.RecordBatch.from_arrays([pa.array(s[at][count >= hot_from]), pa.array(count[count >= hot_from])], ["s", "count"])

    return _of_buckets(np.int64, work)


def _prefixes(width: int, percent: int, hot, buckets: int):
    """Entries of the documents' windows, dealt out by shingle. Of documents with equal sets that a task meets together, the one with the least id has entries."""

    def dealt(held):
        key, name, n = (np.array([h[k] for h in held], dtype=t) for k, t in ((0, np.int64), (1, np.int64), (2, np.int32)))
        order = np.lexsort((name, n, key))
        order = order[np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (n[order][1:] != n[order][:-1])])]
        length = np.array([len(held[k][3]) for k in order.tolist()])
        s = np.concatenate([held[k][3] for k in order.tolist()])
        rows = np.empty(len(s), ENTRY)
        for c, x in (("id", name), ("k", key), ("n", n)):
            rows[c] = np.repeat(x[order], length)
        rows["s"], rows["p"] = s, np.arange(len(s)) - np.repeat(np.cumsum(length) - length, length)
        return _blobs(rows, s, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, held, size = hot.value, [], 0
        for b in batches:
            for name, s in zip(b.column(0).to_pylist(), textnum.shingle_sets(b.column(1), width), strict=True):
                if name is None or not len(s):
                    continue
                key, n = set_key(s), len(s)
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                held.append((key, name, n, s[: window(n, percent)].copy()))
                size += len(held[-1][3])
                if size >= DEAL:
                    yield from dealt(held)
                    held, size = [], 0
        if held:
            yield from dealt(held)

    return run


def _pack_pairs(s, a, b, big):
    return pa.RecordBatch.from_arrays([pa.array(s), pa.array(a), pa.array(b), pa.array(np.full(len(a), big))], ["s", "a", "b", "big"])


def _pairs(percent: int, small: int, s, c, n, dn, p, comp) -> Iterator[pa.RecordBatch]:
    """Candidates of small regions, and the members of larger ones (big), from rows sorted by region s."""
    a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    length = np.diff(np.concatenate([start, [len(s)]]))
    length = np.repeat(length, length)
    large = length > small
    over_s, over_c = s[large], c[large]
    for lag in range(1, int(length[~large].max(initial=1))):
        if not lag & (lag - 1):  # regions that have no more pairs go
            more = (length > lag) & (length <= small)
            s, c, n, dn, p, comp, length = (x[more] for x in (s, c, n, dn, p, comp, length))
        i = np.flatnonzero(s[lag:] == s[:-lag])
        j = i + lag
        apart = n[i] + n[j] - 2 * needed(n[i], n[j], percent)  # most that linked sets differ by
        shared = (dn[i] + dn[j] - apart + 1) // 2  # so least that their differences from the pivot share
        good = (np.minimum(dn[i] - p[i], dn[j] - p[j]) >= shared) & (apart >= np.abs(n[i] - n[j])) & (comp[i] != comp[j])
        a_out.append(np.minimum(c[i], c[j])[good])
        b_out.append(np.maximum(c[i], c[j])[good])
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[once], b[once]
    yield _pack_pairs(np.zeros(len(a), np.int64), a, b, False)
    yield _pack_pairs(over_s, over_c, over_c, True)


def _first_pairs(percent: int, small: int):
    """Candidates and big regions of the first level, from dealt entries. Equal sets have equal windows, so in each region the least id stands for them: their class's."""

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows[np.argsort(rows["s"], kind="stable")]
        same = rows["s"][1:] == rows["s"][:-1]
        rows = rows[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # a shingle of one row joins nothing
        rows = rows[np.lexsort((rows["id"], rows["n"], rows["k"], rows["s"]))]
        once = np.ones(len(rows), dtype=bool)
        once[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("s", "k", "n")], axis=0)
        rows = rows[once]
        s, c, n, p = (rows[x].astype(np.int64) for x in ("s", "id", "n", "p"))
        order = np.lexsort((c, s))
        s, c, n, p = s[order], c[order], n[order], p[order]
        yield from _pairs(percent, small, s, c, n, n, p, c)

    return _of_buckets(ENTRY, work)


def _region_pairs(percent: int, small: int):
    """Candidates of small regions, and the members of larger ones (big), from rows (s, id, n, dn, p, comp) sorted by region s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None  # rows of the last region, which may go on; a large region whose rows pass through
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if large is not None and len(rows[0]):
                more = int(np.searchsorted(rows[0], large, side="right"))
                yield _pack_pairs(rows[0][:more], rows[1][:more], rows[1][:more], True)
                rows = [x[more:] for x in rows]
            if not len(rows[0]):
                continue
            large = None
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield from _pairs(percent, small, *(x[:cut] for x in rows))
            held = [x[cut:] for x in rows]
            if len(held[0]) > small:
                large = held[0][-1]
                yield _pack_pairs(held[0], held[1], held[1], True)
                held = None
        if held is not None:
            yield from _pairs(percent, small, *held)

    return run


def _against_pivot(width: int, percent: int, differences: bool):
    """Each follower's set against its pivot's, from rows (a, b, text, head) sorted with the pivot's own row first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None
        for batch in batches:
            a, b, head = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            out, apart = [], [np.zeros(0, np.int64)]
            for x, y, first, s in zip(a, b, head, textnum.shingle_sets(batch.column(2), width), strict=True):
                if first:
                    pivot, own = x, s
                elif pivot == x:
                    if differences:
                        apart.append(np.setxor1d(own, s, assume_unique=True))
                        dn = len(apart[-1])
                        both = (len(own) + len(s) - dn) // 2
                    else:
                        both = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                        dn = len(own) + len(s) - 2 * both
                    out.append((x, y, len(s), dn, 100 * both >= percent * (len(own) + len(s) - both)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            lengths = np.cumsum([0, *map(len, apart[1:])] if differences else np.zeros(len(out) + 1)).astype(np.int32)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(apart)))], ["a", "b", "n", "dn", "linked", "apart"])

    return run


def _leaf(percent: int):
    """Links (u, v) among the members of each pivot, as a forest, from rows (a, b, n, dn, linked, apart) sorted by pivot a."""

    def links(a, b, n, dn, near, apart, offsets):
        m = len(b)
        comp = np.where(near, m, np.arange(m))  # m is the pivot's
        out = [(a, int(x)) for x in b[near]]
        score = (100 + percent) * dn - (100 - percent) * n  # two members link where their scores sum to 0 or less
        least = int(np.argmin(score))
        for k in np.flatnonzero(score + score[least] <= 0).tolist():
            if comp[k] != comp[least]:
                out.append((int(b[least]), int(b[k])))
                comp[comp == comp[k]] = comp[least]
        if (comp == comp[0]).all():
            return out
        owner = np.repeat(np.arange(m), np.diff(offsets))
        _, token, times = np.unique(apart, return_inverse=True, return_counts=True)
        order = np.lexsort((token, times[token], owner))  # owners stay in place, their tokens come rare ones first
        place = np.arange(len(owner)) - offsets[owner]
        reach = ((100 - percent) * (percent * n + 100 * n)) // (percent * (100 + percent))  # the most a partner can differ by
        use = (place <= reach[owner]) & (times[token[order]] > 1)
        entry_owner, entry_token = owner[use], token[order][use]
        by_token = np.argsort(entry_token, kind="stable")
        posting, at = entry_owner[by_token], np.searchsorted(entry_token[by_token], np.arange(len(times) + 1))
        mine = np.searchsorted(entry_owner, np.arange(m + 1))
        for x in range(m):
            own = entry_token[mine[x] : mine[x + 1]]
            if not len(own):
                continue
            found = np.unique(np.concatenate([posting[at[t] : at[t + 1]] for t in own.tolist()]))
            found = found[(found > x) & (comp[found] != comp[x])]
            most = n[x] + n[found] - 2 * needed(n[x], n[found], percent)
            found = found[(most >= np.abs(n[x] - n[found])) & (most >= np.abs(dn[x] - dn[found]))]
            for k in range(0, len(found), 1024):
                part = found[k : k + 1024]
                length = dn[part]
                spans = np.repeat(offsets[part] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
                mine_sorted = apart[offsets[x] : offsets[x + 1]]
                hit = mine_sorted[np.minimum(np.searchsorted(mine_sorted, apart[spans]), len(mine_sorted) - 1)] == apart[spans]
                both = np.bincount(np.repeat(np.arange(len(part)), length), hit, len(part)).astype(np.int64)
                good = dn[x] + length - 2 * both <= n[x] + n[part] - 2 * needed(n[x], n[part], percent)
                for y in part[good].tolist():
                    if comp[y] != comp[x]:
                        out.append((int(b[x]), int(b[y])))
                        comp[comp == comp[y]] = comp[x]
            if (comp == comp[x]).all():
                break
        return out

    def solved(held):
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lists = rows.column(5)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        n, dn = (rows.column(k).to_numpy() for k in (2, 3))
        near = rows.column(4).to_numpy(zero_copy_only=False)
        out = links(rows.column(0)[0].as_py(), rows.column(1).to_numpy(), n, dn, near, lists.flatten().to_numpy(), offsets - offsets[0])
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != a[i]:
                    yield solved(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield solved(held)

    return run


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, differences: bool = False, fan: int = 256) -> DataFrame:
    """(a, b, n, dn, linked, apart) of distinct candidate pairs; texts: (id, text). n: b's size; dn: shingles in one set only (apart, if asked for)."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / fan).cast("long").alias("parts"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "parts"))
    follow = dealt.join(texts, dealt["b"] == texts["id"]).select("a", "b", "text", F.lit(False).alias("head"), "salt")
    heads = many.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt")).join(texts, F.col("a") == texts["id"])
    rows = heads.select("a", F.col("a").alias("b"), "text", F.lit(True).alias("head"), "salt").unionByName(follow)
    dealt_out = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("head"))
    return dealt_out.mapInArrow(_against_pivot(width, percent, differences), "a long, b long, n long, dn long, linked boolean, apart array<long>")


def _folded(sketch: str, other: str) -> Column:
    """sketch, with as many words as other where it has more: positions are low bits of a hash, so its runs of that length add up modulo 2."""
    s, n = F.col(sketch), F.size(other)
    runs = F.sequence(F.lit(0), (F.size(s) / n).cast("int") - 1)
    none = F.array_repeat(F.lit(0).cast("long"), n)
    return F.when(F.size(s) > n, F.aggregate(runs, none, lambda t, k: F.zip_with(t, F.slice(s, k * n + 1, n), lambda x, y: x.bitwiseXOR(y)))).otherwise(s)


def _edges(checked: DataFrame) -> DataFrame:
    return checked.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def similarity_classes(df: DataFrame, width: int = 5, percent: int = 80, hot_from: int = 128, max_hot: int = 1 << 18, small: int = 256, leaf: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of df."""
    spark = df.sparkSession
    common.ship(spark)
    docs = df.select("doc_id", common.text_or_empty().alias("text"))
    heads = common.keep(docs.mapInArrow(_profiles(width, percent), "doc_id long, n long, k1 long, k2 long, head binary, sketch array<long>"), "jaccard-heads")
    profile = common.keep(heads.select("doc_id", "n", "k1", "k2"), "jaccard-profiles")
    classes = common.keep(profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id")), "jaccard-classes")

    buckets = min(1 << 16, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_bucket = lambda rows: rows.repartition("bucket").sortWithinPartitions("bucket")
    counted = by_bucket(heads.where("n > 0 AND doc_id IS NOT NULL").select("head").mapInArrow(_head_blobs(buckets), "bucket int, blob binary"))
    counts = counted.mapInArrow(_often(hot_from), "s long, count long")
    hot = np.sort(np.array([r["s"] for r in counts.orderBy(F.desc("count"), "s").limit(max_hot).collect()], dtype=np.int64))
    hot_shared = spark.sparkContext.broadcast(hot)
    entries = docs.mapInArrow(_prefixes(width, percent, hot_shared, buckets), "bucket int, blob binary")

    def met(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("s").sortWithinPartitions("s", "id")
        return common.keep(dealt.mapInArrow(_region_pairs(percent, small), "s long, a long, b long, big boolean"), "jaccard-regions")

    def plausible(pairs: DataFrame) -> DataFrame:
        """pairs without those whose parity sketches differ in more bits than linked sets may differ in shingles."""
        side = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        size = F.col("na") + F.col("nb")
        most = size - 2 * F.ceil(percent * size / (100 + percent))
        odd = F.aggregate(F.zip_with(_folded("sa", "sb"), _folded("sb", "sa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        return pairs.join(side("a"), "a").join(side("b"), "b").where(odd <= most).select("a", "b")

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among pairs: first each document with its first candidate, then the pairs that these stars do not join."""
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        one = common.keep(verified(first, texts, width, percent).drop("apart"), "jaccard-checked")
        star = one.where("linked").select("b", "a")
        side = lambda c: star.select(F.col("b").alias(c), F.col("a").alias(f"r{c}"))
        apart = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        two = common.keep(verified(apart.select("a", "b"), texts, width, percent).drop("apart"), "jaccard-checked")
        used.extend([one, two])
        return _edges(one).unionByName(_edges(two))

    found = common.keep(by_bucket(entries).mapInArrow(_first_pairs(percent, small), "s long, a long, b long, big boolean"), "jaccard-regions")
    met_ids = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id")))
    sketches = common.sift(heads.where("n > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "n", "sketch"), common.sieve(met_ids, "id"), "id")
    sketches = common.keep(sketches.join(classes.select("id"), "id", "left_semi").dropDuplicates(["id"]), "jaccard-sketches")
    common.discard(heads)
    pairs = common.keep(plausible(found.where("NOT big").select("a", "b").distinct()), "jaccard-pairs")
    big = found.where("big").select("s", F.col("a").alias("id"))
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(big.select("id")).distinct()
    wanted = common.keep(wanted, "jaccard-wanted")
    texts = common.keep(common.sift(docs.withColumnRenamed("doc_id", "id"), common.sieve(wanted, "id"), "id").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "jaccard-texts")
    used: list[DataFrame] = [texts, sketches, wanted, pairs]
    links = linked(pairs)

    while not big.isEmpty():
        pivots = big.groupBy("s").agg(F.min("id").alias("a"))
        members = big.join(pivots, "s").where("id <> a").select("a", F.col("id").alias("b")).distinct()
        held = common.keep(verified(members, texts, width, percent, differences=True), "jaccard-differences")
        used += [found, held]
        sizes = held.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
        over = sizes.where(F.col("m") > leaf).select("a")
        few = held.join(over, "a", "left_anti").repartition("a").sortWithinPartitions("a", "b")
        leaves = common.keep(few.mapInArrow(_leaf(percent), "u long, v long"), "jaccard-leaves")
        used.append(leaves)
        links = links.unionByName(leaves)
        if over.isEmpty():
            break
        many = held.join(over, "a", "left_semi")
        score = (100 + percent) * F.col("dn") - (100 - percent) * F.col("n")
        best = many.groupBy("a").agg(F.min(F.struct(score.alias("score"), F.col("b").alias("least"))).alias("m")).select("a", "m.*")
        close = many.join(best, "a").withColumn("comp", F.when(F.col("linked"), F.col("a")).when(score + F.col("score") <= 0, F.col("least")).otherwise(F.col("b")))
        links = links.unionByName(close.where("comp <> b").select(F.col("comp").alias("u"), F.col("b").alias("v")))
        # a star whose centre is linked to the pivot is the pivot's
        hub = close.where("b = least").select(F.col("a").alias("ha"), F.col("linked").alias("hl"))
        state = close.join(hub, F.col("a") == F.col("ha")).withColumn("comp", F.when(F.col("hl") & (F.col("comp") == F.col("least")), F.col("a")).otherwise(F.col("comp")))
        tokens = common.keep(state.select("a", "b", "n", "dn", "comp", F.explode("apart").alias("token")), "jaccard-tokens")
        used.append(tokens)
        often = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("k > 1")  # a token of one member joins nothing, but has its place
        ranked = tokens.join(often, ["a", "token"], "left").withColumn("p", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.coalesce("k", F.lit(1)), "token")) - 1)
        reach = F.floor((100 - percent) * (F.col("n") + 100 * F.col("n") / percent) / (100 + percent))  # the most a partner can differ by
        rows = ranked.where("k IS NOT NULL AND x <> y").where(F.col("p") <= reach)  # nor does one whose members are joined
        found = met(rows.select(F.xxhash64("a", "token").alias("s"), F.col("b").alias("id"), "n", "dn", F.col("p").cast("long").alias("p"), "comp"))
        pairs = common.keep(plausible(found.where("NOT big").select("a", "b").distinct()), "jaccard-pairs")
        used.append(pairs)
        links = links.unionByName(linked(pairs))
        big = found.where("big").select("s", F.col("a").alias("id"))

    roots = components(links, "jaccard-roots")
    common.discard(*used)
    rooted = classes.join(roots, F.col("id") == F.col("u"), "left").select("n", "k1", "k2", F.coalesce("root", "id").alias("root"))
    return profile.join(rooted, ["n", "k1", "k2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")
    )


def keep_one(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """df's rows of each component's smallest doc_id (and rows with a null doc_id); repeated rows become one. Texts move once: rows of one doc_id meet, and are merged there."""
    stay = similarity_classes(df, width, percent).where("component_id = doc_id OR doc_id IS NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id")).distinct()
    rows = df.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__digest", F.sha2(common.text_or_empty(), 256))
    return rows.join(stay, "__id", "left_semi").dropDuplicates(["__id", "__digest"]).drop("__id", "__digest")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(common.documents(spark, sf_dir), width=4, percent=85)
