"""Packing documents into sequences by lexical retrieval.

* Tokens: the tokenizer's normaliser and splitter never join characters across white space, nor an ASCII letter and another ASCII character
  that is not an apostrophe. So a text is cut there, distinct pieces are tokenised once a worker (those of Latin letters with the normaliser and
  splitter left out, which would only lower-case them), and the ids are put together by array gathers. Texts beside a special token's string are tokenised whole.
* Statistics: in how many documents each token id occurs, over all documents (a number an id of the vocabulary, so a bounded broadcast).
* Routing: documents are put in the order of two min-hashes of the token ids they share with others, rare ids preferred (weight idf squared), and dealt by
  ranges of it, of about equal tokens by a sample that the tokens' tasks take. So documents with rare terms in common meet whatever the layout of the files;
  a group that is too large for a task goes to several.
* Shards: a task packs its documents in blocks of about `block_tokens` tokens (half to one and a half times, or all there is). A block has an inverted
  index of BM25 weights, with the statistics of the whole table. A seed document (the first unused one) asks for all of its terms but the end token; unused
  documents of the block by falling score fill its window. The document that reaches the window's end is cut there and its rest is the next seed; so is
  what is left at a block's end. A window takes no second copy of a document while the block has others. Only when no unused document has a term of the seed's, the next unused one goes on. A task's last tokens go to sequences
  whose lengths are powers of two. So no sequence has padding, and each id lies in one piece.

Neighbours in other blocks are not seen (README has the share). A task holds one and a half blocks and a document. Results depend on how the table is
split into scan tasks and, where scores tie but for rounding, on the machine's arithmetic.

Nulls: a null text is empty and has the end token alone; a null doc_id stays null. Repeated rows are packed one by one. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

END, VOCABULARY = 2, 49408
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")
KIND = np.zeros(256, dtype=np.uint8)  # 0: joins either side, 1: ASCII letter, 2: other ASCII, 3: white space
KIND[:128] = 2
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[ord("'")] = 0
KIND[textnum.SPACE] = 3
CACHE = 1 << 20  # pieces a worker remembers
LATIN = np.zeros(256, dtype=np.uint8)  # 0: not in a Latin letter, 1: one by itself, or a space, 2: may begin one, 3: may end one
LATIN[[*np.flatnonzero(KIND == 1), 32]] = 1
LATIN[0xC3:0xCA] = 2
LATIN[0x80:0xC0] = 3
STRIDE = 32  # of a task's documents one in so many is in the sample for the ranges, and the first so many


def spaced(d: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces d[begin:end] with a space behind each, and where they begin and end."""
    length = end - begin + 1
    at = np.concatenate([[0], np.cumsum(length)])
    place = np.repeat(begin - at[:-1], length) + np.arange(at[-1])
    place[at[1:] - 1] = 0
    text = d[place]
    text[at[1:] - 1] = 32
    return text, at


def latin(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which pieces have Latin letters only, such as NFC leaves alone and as lower-case one by one: A-Z, a-z, U+00C0 to U+024F but U+00D7, U+00F7 and U+0130."""
    kind = LATIN[text]
    other = kind == 0
    other[:-1] |= (kind[:-1] == 2) & (kind[1:] != 3)
    other[1:] |= (kind[1:] == 3) & (kind[:-1] != 2)
    lead = np.flatnonzero(kind[:-1] == 2)
    pair = text[lead].astype(np.int32) << 8 | text[lead + 1]
    other[lead[(pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair > 0xC98F)]] = True
    return ~np.logical_or.reduceat(other, starts)


class Pieces:
    """Token ids of texts, with the ids of pieces seen before kept: a table of slots by hash, as numbers of pieces. Piece 1 is the end token, 0 none."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # for pieces that are lower-cased and split already
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.final = np.zeros(1 << 16, dtype=bool)  # tokens that end a word
        self.final[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget(CACHE)

    def forget(self, room: int) -> None:
        self.n, self.room, self.n_ids = 2, room, 1
        self.hashes, self.first, self.length = np.zeros(room + 2, np.uint64), np.zeros(room + 2, np.int32), np.zeros(room + 2, np.int32)
        self.ids, self.length[1] = np.full(4 * room, END, np.uint16), 1
        self.bits = max(1, (2 * room - 1).bit_length())
        self.slots = np.zeros(1 << self.bits, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pieces, 0 for those not seen."""
        slot = self._slot(hashes)
        at = self.slots[slot]
        other = np.flatnonzero((self.hashes[at] != hashes) & (at > 0))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.slots) - 1)
            at[other] = x = self.slots[slot[other]]
            other = other[(self.hashes[x] != hashes[other]) & (x > 0)]
        return at

    def learn(self, hashes: np.ndarray, d: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Tokenises new distinct pieces d[begin:end], many in one string. A piece of plain letters is one word to the tokenizer, and a word's last id tells that it is one."""
        text, at = spaced(d, begin, end)
        letters, ids, owners = latin(text, at[:-1]), [], []
        for plain in (True, False):
            which = np.flatnonzero(letters == plain)
            for k in range(0, len(which), 1000):
                own = which[k : k + 1000]
                if plain:
                    part = text if len(own) == len(letters) else spaced(d, begin[own], end[own])[0]
                    found = np.array(self.words.encode_batch_fast([part.tobytes().decode().lower()], add_special_tokens=False)[0].ids, dtype=np.uint16)
                    owner = np.concatenate([[0], np.cumsum(self.final[found])[:-1]])
                else:
                    part = [d[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(begin[own].tolist(), end[own].tolist(), strict=True)]
                    e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                    found, starts = np.array(e.ids, dtype=np.uint16), np.cumsum([0, *(len(t) + 1 for t in part[:-1])])
                    owner = np.searchsorted(starts, np.array([x for x, _ in e.offsets]), side="right") - 1
                ids.append(found)
                owners.append(own[owner])
        ids, owners = np.concatenate([np.zeros(0, np.uint16), *ids]), np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(owners, kind="stable")
        length = np.bincount(owners, minlength=len(hashes))
        own = slice(self.n, self.n + len(hashes))
        self.hashes[own], self.first[own], self.length[own] = hashes, np.cumsum(length) - length + self.n_ids, length
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint16)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids[order]
        todo, slot = np.arange(own.start, own.stop, dtype=np.int32), self._slot(hashes)
        self.n, self.n_ids = own.stop, self.n_ids + len(ids)
        while len(todo):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = todo[free]
            rest = self.slots[slot] != todo  # taken before or by another of these
            todo, slot = todo[rest], (slot[rest] + 1) & (len(self.slots) - 1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint16 ids of the documents of a chunk, each with the end token, and where they begin and end."""
        lo = int(offsets[0])
        d = data[lo : int(offsets[-1])]
        raw = d.tobytes()
        if any(s in raw for s in SPECIAL):
            docs = [np.array([*self.tokenizer.encode(bytes(data[a:b]).decode("utf-8", "replace"), add_special_tokens=False).ids, END], dtype=np.uint16) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate(docs), np.cumsum([0, *map(len, docs)])
        rel, kind = offsets - lo, KIND[d]
        inside = kind != 3
        edge = np.zeros(len(d) + 1, dtype=bool)  # a piece may not go on from the byte before
        edge[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] * kind[:-1] == 2) | ~inside[:-1]
        edge[rel] = edge[-1] = True
        begin = np.flatnonzero(inside & edge[:-1])
        stop = edge[1:].copy()
        stop[:-1] |= ~inside[1:]
        end = np.flatnonzero(inside & stop) + 1
        h = textnum.span_hash(textnum.sums(textnum.FOLD[d]), begin, end)
        at = self.find(h)
        missing = np.flatnonzero(at == 0)
        if len(missing):
            distinct, sample = np.unique(h[missing], return_index=True)
            if self.n + len(distinct) > self.room:
                distinct, sample = np.unique(h, return_index=True)
                self.forget(max(CACHE, len(distinct) + 2))
                missing = np.arange(len(h))
            s = missing[sample]
            self.learn(distinct, d, begin[s], end[s])
            at[missing] = self.find(h[missing])
        last = np.searchsorted(begin, rel[1:]) + np.arange(len(rel) - 1)  # where the documents' end tokens come
        own = np.ones(len(at) + len(last), dtype=bool)
        own[last] = False
        pieces = np.ones(len(own), dtype=np.int32)
        pieces[own] = at
        length = self.length[pieces]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat((self.first[pieces] - (ends - length)).astype(np.int32), length) + np.arange(int(ends[-1]), dtype=np.int32)]
        return ids, np.concatenate([[0], ends[last]])


_pieces: dict[str, Pieces] = {}


def _tokens(path: str):
    """Rows (doc_id, ids) of the documents and, last, a row (null, frequencies) of the task with a sample: numbers of tokens stood for, of distinct ids, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textnum.trim()
        if path not in _pieces:
            _pieces[path] = Pieces(path)
        seen, n, total, sample = np.zeros(VOCABULARY, np.int64), 0, 0, []
        mark = np.zeros(VOCABULARY, np.int32)
        for batch in batches:
            data, offsets = textnum.column_bytes(batch.column(1))
            for i, j in textnum.chunks(offsets, textnum.PART):
                ids, at = _pieces[path].encode(data, offsets[i : j + 1])
                places, once = np.arange(int(np.diff(at).max()), dtype=np.int32), []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    x = ids[a:b]
                    mark[x] = places[: b - a]
                    once.append(x[mark[x] == places[: b - a]])  # one place of each of the document's ids
                seen += np.bincount(np.concatenate(once), minlength=VOCABULARY)
                sample += [((STRIDE if n + k >= STRIDE else 1) * int(at[k + 1] - at[k]), once[k]) for k in range(j - i) if n + k < STRIDE or (n + k) % STRIDE == 0]
                n += j - i
                total += len(ids)
                blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), blobs, pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.binary())], ["doc_id", "ids", "n", "sample"])
        some = np.array([[w, len(x)] for w, x in sample], "<i8").tobytes() + b"".join(x.tobytes() for _, x in sample)
        last = [np.append(seen, total).astype("<u8").tobytes(), some]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array(last[:1], pa.binary()), pa.array([n], pa.int64()), pa.array(last[1:], pa.binary())], ["doc_id", "ids", "n", "sample"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob, n in zip(batch.column(0), batch.column(1), strict=True):
            f = np.append(np.frombuffer(blob.as_py(), "<u8").astype(np.int64), n.as_py())
            at = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(f[at])], ["id", "f"])


def keys_of(codes: np.ndarray, ids: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number for each document: its least codes, of the first row and then of the second, and 31 bits that part equal ones."""
    first, second = (np.minimum.reduceat(c[ids], starts).astype(np.int64) for c in codes)
    return first << 47 | second << 31 | (textnum.mix(row.astype(np.uint64)) >> np.uint64(33)).astype(np.int64)


def _sampled(shared):
    """(key, tokens stood for) of the documents in the tasks' samples of n documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m := min(n, STRIDE) + max(0, (n - 1) // STRIDE):
                    weight, length = np.frombuffer(blob, "<i8", 2 * m).reshape(m, 2).T
                    row = (TaskContext.get().partitionId() << 32) + np.arange(m)
                    keys = keys_of(shared.value, np.frombuffer(blob, "<u2", offset=16 * m), np.cumsum(length) - length, row)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(weight)], ["key", "weight"])

    return run


def range_ends(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Keys at which ranges of about equal weight end."""
    order = np.argsort(keys)
    reached = np.cumsum(weights[order])
    return keys[order][np.searchsorted(reached, reached[-1] * np.arange(1, parts) / parts)] if parts > 1 and len(keys) else np.zeros(0, np.int64)


def _route(shared):
    """Adds the key by which documents with rare shared terms meet, and the number of its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (codes, ends), row = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = textnum.column_bytes(batch.column(1))
            lo = int(offsets[0])
            keys = keys_of(codes, data[lo : int(offsets[-1])].view(np.uint16), (offsets[:-1] - lo) // 2, row + np.arange(len(batch)))
            part = np.searchsorted(ends, keys).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(part)], ["doc_id", "ids", "key", "part"])
            row += len(batch)

    return run


def route_codes(idf: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Two rows of a number for each token id: the least of a document's is its code. Ids of one document, and the end token, have the largest."""
    u = np.random.default_rng(5).random((2, len(f)))
    keys = -np.log1p(-u) / np.maximum(idf, 1e-6) ** 2
    keys[:, f < 2] = keys[:, END] = np.inf
    codes = np.argsort(np.argsort(keys)).astype(np.int32)
    codes[np.isinf(keys)] = (1 << 16) - 1
    return codes


class Index:
    """BM25 weights of a block's documents, by term and by document. The end token, which all have, is no term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        lengths = np.array([len(x) for x in docs], dtype=np.float64)
        number = np.arange(len(docs), dtype=np.uint32 if len(docs) <= 1 << 16 else np.uint64) << 16
        pair = np.sort(np.repeat(number, lengths.astype(np.int64)) | np.concatenate(docs))
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, tf = pair[first], np.diff(np.append(first, len(pair)))
        term = (pair & 0xFFFF).astype(np.int64)
        pair, tf, term = pair[term != END], tf[term != END], term[term != END]
        doc = (pair >> 16).astype(np.int64)
        norm = k1 * (1 - b + b * lengths / max(mean, 1))
        weight = idf[term] * tf * (k1 + 1) / (tf + norm[doc])
        self.doc_at, self.term = np.searchsorted(doc, np.arange(len(docs) + 1)), term
        order = np.argsort(term.astype(np.uint16), kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_at = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.n = len(docs)
        self.left = np.arange(self.n)  # documents that postings still have
        self._rows()

    def _rows(self) -> None:
        """Terms of a sixth of the documents or more have a whole row of weights."""
        often = np.flatnonzero(np.diff(self.post_at) * 6 >= max(len(self.left), 6))
        self.row = np.full(VOCABULARY, -1)
        self.row[often] = np.arange(len(often))
        self.whole = np.zeros((len(often), len(self.left)))
        for k, t in enumerate(often.tolist()):
            own = slice(self.post_at[t], self.post_at[t + 1])
            self.whole[k, self.post_doc[own]] = self.post_weight[own]

    def forget(self, unused: np.ndarray) -> None:
        """Takes used documents out of the postings."""
        stay = unused[self.left]
        ok = stay[self.post_doc]
        self.post_at = np.concatenate([[0], np.cumsum(ok)])[self.post_at]
        self.post_doc, self.post_weight = (np.cumsum(stay) - 1)[self.post_doc[ok]], self.post_weight[ok]
        self.left = self.left[stay]
        self._rows()

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document for all terms of the seed's; 0 for those forgotten."""
        terms = self.term[self.doc_at[seed] : self.doc_at[seed + 1]]
        if not len(terms):
            return np.zeros(self.n)
        row = self.row[terms]
        own = np.zeros(len(self.whole))
        own[row[row >= 0]] = 1
        score, terms = own @ self.whole, terms[row < 0]
        if len(terms):
            spans = list(zip(self.post_at[terms].tolist(), self.post_at[terms + 1].tolist(), strict=True))
            score += np.bincount(np.concatenate([self.post_doc[p:q] for p, q in spans]), np.concatenate([self.post_weight[p:q] for p, q in spans]), len(self.left))
        out = np.zeros(self.n)
        out[self.left] = score
        return out

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents with a term of the seed's, by falling score."""
        score = self.scores(seed)
        score[~unused] = 0
        found, many = np.flatnonzero(score), 64
        while len(found):
            s = score[found]
            head = s >= np.partition(s, -many)[-many] if len(found) > many else np.ones(len(found), dtype=bool)  # as many as the window may take; ties stay together
            best = found[head]
            yield from best[np.lexsort((best, -s[head]))].tolist()
            found, many = found[~head], 8 * many


def _pack(window: int, block_tokens: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        sequence, out = TaskContext.get().partitionId() << 32, []
        held: list[tuple] = []  # what the open window has: (doc_id, ids, start, end)
        inside: set[bytes] = set()  # digests of the documents in it
        room = window

        def close():
            nonlocal sequence, room
            at = 0
            for doc, ids, start, end in held:
                out.append((doc, start, end - start, zlib.crc32(ids[start:end].astype("<u4").tobytes()), len(ids), sequence, at))
                at += end - start
            held.clear()
            inside.clear()
            sequence += 1
            room = window

        def put(doc, ids, start, digest):
            """Adds ids from start on to the open window; returns where the window ended if it did."""
            nonlocal room
            while start < len(ids):
                inside.add(digest)
                end = min(len(ids), start + room)
                held.append((doc, ids, start, end))
                room -= end - start
                start = end
                if not room:
                    close()
                    return start
            return start

        def block(names, docs):
            index, unused = Index(docs, idf, mean), np.ones(len(docs), dtype=bool)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in docs]
            first, seed = 0, None
            while True:
                if seed is None:
                    while first < len(docs) and not unused[first]:
                        first += 1
                    if first == len(docs):
                        return
                    seed, start = first, 0
                    if digests[seed] in inside:  # a copy waits for another window, while there are other documents
                        seed = next((k for k in np.flatnonzero(unused).tolist() if digests[k] not in inside), first)
                    unused[seed] = False
                while start < len(docs[seed]) and (len(docs[seed]) - start >= room):
                    start = put(names[seed], docs[seed], start, digests[seed])
                put(names[seed], docs[seed], start, digests[seed])
                own, seed = seed, None
                if unused.sum() < 0.8 * len(index.left):
                    index.forget(unused)
                if room == window:
                    continue
                for k in index.neighbours(own, unused):  # the seed's window has room
                    if digests[k] in inside:
                        continue
                    unused[k] = False
                    at = put(names[k], docs[k], 0, digests[k])
                    if room == window:
                        if at < len(docs[k]):
                            seed, start = k, at
                        break

        def rows():
            nonlocal out
            cols = list(zip(*out, strict=True)) or [[]] * 7
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        names, docs, total = [], [], 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                docs.append(np.frombuffer(ids.as_py(), "<u2"))
                total += len(docs[-1])
                if 2 * total >= 3 * block_tokens:  # so what is left at the end is half a block at least
                    cut = int(np.searchsorted(np.cumsum([len(x) for x in docs]), block_tokens)) + 1
                    block(names[:cut], docs[:cut])
                    yield rows()
                    names, docs = names[cut:], docs[cut:]
                    total = sum(map(len, docs))
        if docs:
            block(names, docs)
        rest, length = list(held), window - room
        held.clear()
        for power in sorted((1 << k for k in range(length.bit_length()) if length >> k & 1), reverse=True):  # no padding at a power of two
            room = power
            while room and rest:
                doc, ids, start, end = rest.pop(0)
                cut = min(end, start + room)
                held.append((doc, ids, start, cut))
                room -= cut - start
                if cut < end:
                    rest.insert(0, (doc, ids, cut, end))
            close()
        yield rows()

    return run


def pack(df: DataFrame, tokenizer: str | None = None, window: int = 4096, block_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark = df.sparkSession
    common.ship(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    table = common.keep(df.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(_tokens(tokenizer), "doc_id long, ids binary, n long, sample binary"), "pack-tokens")
    found = {r["id"]: r["f"] for r in table.where("n IS NOT NULL").select("ids", "n").mapInArrow(_frequencies, "id long, f long").groupBy("id").agg(F.sum("f").alias("f")).collect()}
    total, n, f = found.get(VOCABULARY, 0), found.get(VOCABULARY + 1, 0), np.zeros(1 << 16)
    for k, v in found.items():
        if k < VOCABULARY:
            f[k] = v
    idf = np.log1p((n - f + 0.5) / (f + 0.5))
    parts, codes = max(1, -(-total // (2 * block_tokens))), spark.sparkContext.broadcast(route_codes(idf, f))
    ends = np.zeros(0, np.int64)
    if parts > 1:
        sample = table.where("n IS NOT NULL").select("n", "sample").mapInArrow(_sampled(codes), "key long, weight long").toArrow()
        ends = range_ends(sample["key"].to_numpy(), sample["weight"].to_numpy(), parts)
    ranges, shared = spark.sparkContext.broadcast((codes.value, ends)), spark.sparkContext.broadcast((idf, total / max(n, 1)))
    routed = table.where("n IS NULL").select("doc_id", "ids").mapInArrow(_route(ranges), "doc_id long, ids binary, key long, part int")
    routed = routed.repartitionById(parts, "part").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    return routed.mapInArrow(_pack(window, block_tokens, shared), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
