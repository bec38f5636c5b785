"""Removal of repeated byte strings with a sparse enhanced suffix array.

Every byte covered by a `length`-byte string that also starts anywhere else (another document or the same one) goes. Strings are judged on
the input; matches never cross documents.

* Anchors: of the `gram`-byte strings in a window of `length` bytes the one with the least hash (the rightmost of equals) is the window's
  anchor. The choice depends on the window's bytes only, so equal windows have equal anchors at equal places; the windows of one anchor are a
  run. There are about 2 / length anchors a byte, and only they are sorted, not all suffixes.
* Runs with equal bytes are one class (map-side merged): a class with two occurrences repeats as a whole, which settles the inside of copies.
* Two other classes can share a window only if they share the anchor and, on one side of it at least, half of the window's other bytes. Classes that
  share neither half with another one are done: they have no repeats.
* The others get their context (the run's bytes on either side of the anchor), and those of an anchor string meet. They are sorted by the suffix from the
  anchor; a stack scan over the common prefixes yields the interval tree; in every interval the members, in the order of what stands left of
  the anchor, read backwards, each take the longest left extension that another member shares (minima of the neighbours' common lengths). Where
  that differs among members the interval is left-diverse: a maximal repeat. A member whose left and right extension reach `length`
  together repeats there, whichever member it shares them with, so all occurrences are found and not neighbours alone.
* A task holds `cap` classes of an anchor string at most (cap times 800 bytes). Larger groups are dealt anew by what their windows share: the places where
  a window may start are cut into `PARTS` bands, and classes that share a window of a band share all bytes that every window of the band has. Bands with
  more than `cap` classes are cut again; one place is left at last, where the classes of a group share that window. The members of a group are so many rows of
  several tasks, no link is lost, and what is left alone in its band is done.
* Texts are moved only for documents that need their context read or have something removed; bitmaps of 2 MB keep the others in the scan.

Anchors and windows are compared by 64-bit hashes of bytes within one 64-bit anchor hash.

Nulls: a null text is empty; a null doc_id is an id of its own. Texts under `length` bytes have nothing to remove. Repeated rows repeat each other
and lose all that is long enough. Texts of any length are worked on in pieces. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

U = np.uint64
LOW = (1 << 24) - 1
NO_ID = -(1 << 63)
PIECE = 1 << 19  # bytes of text worked on at once: each takes some 100 bytes of memory meanwhile


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours: block prefix and suffix minima."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, end, starts of the documents in between and the end) of pieces; pieces of a long document share length - 1 bytes."""
    for i, j in textnum.chunks(offsets, PIECE):
        lo, hi = int(offsets[i]), int(offsets[j])
        if j - i > 1 or hi - lo <= 2 * PIECE:
            yield i, lo, offsets[i : j + 1]
        else:
            for at in range(lo, max(lo + 1, hi - length + 1), PIECE):
                yield i, lo, np.array([at, min(hi, at + PIECE + length - 1)])


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnum.column_bytes(batch.column(2))
            out = []
            for i, first, own in _segments(offsets, length):
                d = data[own[0] : own[-1]]
                if len(d) < length:
                    continue
                c = textnum.sums(d)
                v = textnum.mix((c[gram:] - c[:-gram]) * textnum.powers(textnum.INVERSE, len(d))[: len(d) - gram + 1])
                place = LOW - np.arange(len(v), dtype=np.int64)
                least = sliding_min((v & ~U(LOW)) | place.astype(U), length - gram + 1)
                rel = own - own[0]
                ok = np.zeros(len(least) + 1, dtype=np.int64)  # windows that lie within a document
                lo, hi = rel[:-1], rel[1:] - length + 1
                np.add.at(ok, lo[hi > lo], 1)
                np.add.at(ok, hi[hi > lo], -1)
                at = np.flatnonzero(np.cumsum(ok[:-1]))
                if not len(at):
                    continue
                p = LOW - (least[at] & U(LOW)).astype(np.int64)
                new = np.concatenate([[True], p[1:] != p[:-1]])
                begin, p = at[new], p[new]
                end = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
                doc = np.searchsorted(rel, begin, side="right") - 1
                bytes_hash = textnum.span_hash(c, begin, end + length)
                geometry = ((p - begin) * 65536 + (end - begin)).astype(U)
                half = (length - gram + 1) // 2
                sides = []
                for has, x in ((p - begin >= half, p - half), (end - p + length - gram >= half, p + gram)):
                    x = np.where(has, x, 0)
                    sides.append(np.where(has, textnum.mix(textnum.span_hash(c, x, x + has * half) ^ v[p] + U(len(sides))).view(np.int64), 0))
                base = own[0] - (offsets[i + doc] if len(own) > 2 else first)
                out.append((i + doc, p + base, p - begin, end - p, v[p].view(np.int64), textnum.mix(bytes_hash ^ textnum.mix(geometry)).view(np.int64), *sides))
            if out:
                doc, *cols = (np.concatenate(x) for x in zip(*out, strict=True))
                take = pa.array(doc)
                back, ahead = (pa.array(cols[k].astype(np.int32)) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cols[0]), back, ahead, *map(pa.array, cols[3:])], ["id", "th", "p", "back", "ahead", "g", "rh", "xl", "xr"])

    return run


PARTS = 8
CONTEXT = "id long, th long, p long, single boolean, g long, left binary, right binary"


def _contexts(length: int):
    """From (id, th, text, [(g, p, back, ahead, single)]): the bytes left of each anchor backwards, and those from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnum.column_bytes(batch.column(2))
            raw = data.tobytes() if len(data) < 1 << 26 else memoryview(data)
            lists = batch.column(3)
            items = lists.flatten()
            doc = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
            g, p, back, ahead, single = (items.field(k) for k in range(5))
            at = offsets[doc] + p.to_numpy()
            lo, hi = at - back.to_numpy(), at + ahead.to_numpy() + length
            for k in range(0, len(at), 20000):
                cut = slice(k, k + 20000)
                left = [bytes(raw[a:b])[::-1] for a, b in zip(lo[cut].tolist(), at[cut].tolist(), strict=True)]
                right = [bytes(raw[a:b]) for a, b in zip(at[cut].tolist(), hi[cut].tolist(), strict=True)]
                own = pa.array(doc[cut])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), p[cut], single[cut], g[cut], pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["id", "th", "p", "single", "g", "left", "right"])

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 16:  # the first difference lies in lo..n
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of the inner nodes of the interval tree, by a stack scan; lcp[i] is that of suffixes i and i + 1."""
    stack = [(0, 0)]
    for i, h in enumerate([*lcp, 0]):
        first = i
        while stack[-1][0] > h:
            depth, first = stack.pop()
            yield depth, first, i
        if stack[-1][0] < h:
            stack.append((h, first))


def _in_order(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    order = sorted(range(len(texts)), key=texts.__getitem__)
    return np.array(order), [_common(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False)]


class Minima:
    """Minimum of any span of an array, by spans of powers of two."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << len(self.rows) - 1 <= len(x):
            last, w = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-w], last[w:]))

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of x[a:b], for each a < b."""
        level = np.frexp(b - a)[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << k)])
        return out


def by_tree(left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, first, last) of the runs of window starts, relative to the member's anchor, that another member shares."""
    order, lcp = _in_order(right)
    by_left, shared = _in_order(left)
    minima, rank = Minima(np.array(shared, dtype=np.int64)), np.empty(len(left), dtype=np.int64)
    rank[by_left] = np.arange(len(left))
    rank = rank[order]
    longest = max(shared, default=0)
    member, lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for depth, first, last in intervals(lcp):
        if depth + longest < length:
            continue
        own = np.sort(rank[first : last + 1])
        near = minima.over(own[:-1], own[1:])
        most = np.maximum(np.append(near, 0), np.append(0, near))  # the longest left extension shared with another member
        good = depth + most >= length
        if good.any():
            member.append(by_left[own[good]])
            lo.append(-most[good])
            hi.append(np.full(int(good.sum()), depth - length))
    x, a, b = (np.concatenate(y) for y in (member, lo, hi))
    order = np.lexsort((a, x))  # overlapping runs of a member are one
    x, a, b = x[order], a[order], b[order]
    wide = x * 4 * length
    reach = np.maximum.accumulate(b + wide) - wide if len(x) else b
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (a[1:] > reach[:-1] + 1)
    start = np.flatnonzero(new)
    return x[start], a[start], np.maximum.reduceat(b, start) if len(x) else b


def _groups(length: int):
    """Runs (id, th, a, b) of the members that occur once, from contexts sorted by group k."""

    def solved(held):
        rows = pa.Table.from_batches(held)
        left, right = rows.column("left").to_pylist(), rows.column("right").to_pylist()
        member, lo, hi = by_tree(left, right, length)
        single = rows.column("single").to_numpy()[member] if len(member) else np.zeros(0, bool)
        own = pa.array(member[single])
        p = rows.column("p").to_numpy()[member[single]]
        one = [rows.column(c).combine_chunks().take(own) for c in ("id", "th")]
        return pa.RecordBatch.from_arrays([*one, pa.array(p + lo[single]), pa.array(p + hi[single])], ["id", "th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("k")[0].as_py() != k[i]:
                    if sum(map(len, held)) > 1:
                        yield solved(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if sum(map(len, held)) > 1:
            yield solved(held)

    return run


def _bands(rows: DataFrame, width: int, length: int) -> DataFrame:
    """The contexts of rows once for each band of `width` starts, from lo on, where they have a window; k: a hash of the bytes that all windows of a band share."""
    rows = rows.withColumn("lo", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.col("lo") + i * width)))
    rows = rows.where((F.col("lo") <= F.length("right") - length) & (F.col("lo") + width - 1 >= -F.length("left")))
    before = F.substring(F.col("left"), F.lit(1), F.greatest(1 - width - F.col("lo"), F.lit(0)))
    return rows.withColumn("k", F.xxhash64("g", "lo", before, F.substring(F.col("right"), F.lit(1), F.col("lo") + length)))


def _dealt(spoken: DataFrame, length: int, gram: int, cap: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """Contexts in groups k of about `cap` at most, starts of repeated windows (id, th, a, b) of larger ones, and the tables that both are read from."""
    width, calm, settled, tables = length - gram + 1, [], [], []
    rows = first = spoken.withColumn("lo", F.lit(1 - width)).withColumn("k", F.col("g"))
    while True:
        counts = common.keep(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-counts")
        tables.append(counts)
        if width == 1:
            start = F.col("p") + F.col("lo")
            single = rows.where("single").select("id", "th", start.alias("a"), start.alias("b"), "k")
            settled.append(_among(single, counts, "k").drop("k"))
            break
        large = counts.where(F.col("n") > cap)
        some = rows if rows is first else common.sift(rows, common.sieve(counts, "k"), "k")  # what was asked for shares its anchor
        if large.isEmpty():
            calm.append(some)
            break
        bitmap = common.sieve(large, "k")  # what it takes by chance is cut too, which loses nothing
        calm.append(common.sift(some, bitmap, "k", out=True))
        hot = common.keep(common.sift(some, bitmap, "k").drop("k"), "suffix-hot")
        tables.append(hot)
        width = -(-width // PARTS)
        rows = _bands(hot, width, length)
    groups = calm[0]
    for more in calm[1:]:
        groups = groups.unionByName(more)
    return groups.drop("g", "lo"), settled, tables


def _among(rows: DataFrame, counts: DataFrame, *keys: str, n: str = "n") -> DataFrame:
    """rows whose keys are in counts (keys, n). Keys with a thousandth of all that is counted, a thousand at most, are broadcast, so that no task gets all their rows."""
    hot_from = max(1000, (counts.agg(F.sum(n)).first()[0] or 0) // 1000)
    names = list(keys)
    hot = F.broadcast(counts.where(F.col(n) >= hot_from).select(*names))
    return rows.join(hot, names, "left_anti").join(counts.where(F.col(n) < hot_from), names, "left_semi").unionByName(rows.join(hot, names, "left_semi"))


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnum.column_bytes(batch.column(1))
            for i, j in textnum.chunks(offsets, PIECE):
                rows = []
                for k in range(i, j):
                    d, runs = data[offsets[k] : offsets[k + 1]], batch.column(2)[k]
                    if runs.values is None or not len(runs.values):
                        rows.append((len(d), 0, 0, hashlib.sha256(d).hexdigest(), d.tobytes().decode("utf-8", "replace")))
                        continue
                    a, b = (runs.values.field(x).to_numpy() for x in (0, 1))
                    edge = np.zeros(len(d) + 1, np.int32)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = d[~gone].tobytes()
                    rows.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
                cols = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return run


ANCHOR = "id long, th long, p long, back int, ahead int, g long, rh long, xl long, xr long"


def repeated_runs(docs: DataFrame, length: int = 400, gram: int = 64, cap: int = 512) -> DataFrame:
    """A written table (id, th, runs): runs (a, b) of starts of repeated windows; docs: (id, th, text)."""
    anchors = common.keep(docs.mapInArrow(_anchors(length, gram), ANCHOR), "suffix-anchors")
    one = F.min(F.struct("id", "th", "p", "back", "ahead")).alias("one")
    classes = common.keep(anchors.groupBy("g", "rh").agg(F.count(F.lit(1)).alias("c"), one, F.min("xl").alias("xl"), F.min("xr").alias("xr")), "suffix-classes")
    halves = classes.withColumn("x", F.explode(F.array("xl", "xr"))).where("x <> 0").drop("xl", "xr")
    shared = common.keep(halves.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).where("n > 1 AND c = 1").select("x"), "suffix-halves")
    asked = common.sift(halves, common.sieve(shared, "x"), "x").join(shared, "x", "left_semi").dropDuplicates(["g", "rh"]).select("g", "c", "one.*")
    asked = common.keep(asked, "suffix-asked")
    ask = asked.select("id", "th", F.struct("g", "p", "back", "ahead", (F.col("c") == 1).alias("single")).alias("x"))
    ask = common.keep(ask.groupBy("id", "th").agg(F.collect_list("x").alias("xs")), "suffix-ask")  # as many as a document has anchors
    texts = common.sift(docs, common.sieve(ask, "id", "th"), "id", "th")
    spoken = texts.join(ask, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "xs")
    spoken = common.keep(spoken.mapInArrow(_contexts(length), CONTEXT), "suffix-contexts")
    common.discard(asked, ask, shared)
    groups, settled, tables = _dealt(spoken, length, gram, cap)
    found = groups.repartition("k").sortWithinPartitions("k").mapInArrow(_groups(length), "id long, th long, a long, b long")
    for more in settled:
        found = found.unionByName(more)
    again = classes.where("c > 1").select("g", "rh", "c")
    several = common.sift(anchors.select("id", "th", "p", "back", "ahead", "g", "rh"), common.sieve(again, "g", "rh"), "g", "rh")
    whole = _among(several, again, "g", "rh", n="c")
    runs = found.unionByName(whole.select("id", "th", (F.col("p") - F.col("back")).alias("a"), (F.col("p") + F.col("ahead")).alias("b")))
    out = common.keep(runs.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "suffix-runs")  # bounded by the text
    common.discard(anchors, classes, spoken, *tables)
    return out


def remove_repeats(df: DataFrame, length: int = 400, gram: int = 64, cap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text: one row for each row of df. text: the remaining bytes (U+FFFD for those of a character that was cut)."""
    common.ship(df.sparkSession)
    text = common.text_or_empty()
    docs = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    runs = repeated_runs(docs, length, gram, cap)
    some = common.sieve(runs, "id", "th")
    hit = common.sift(docs, some, "id", "th").join(runs, ["id", "th"], "left").select("id", "text", "runs")
    rest = common.sift(docs, some, "id", "th", out=True).select("id", "text", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("runs"))
    out = hit.unionByName(rest).mapInArrow(_finish(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir))
