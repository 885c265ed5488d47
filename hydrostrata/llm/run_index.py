"""Exact removal of long byte strings that an earlier document holds, by run-length indexes over a parsed corpus.

Every WIDTH-byte string has a key, the least hash of its GRAM-byte grams, so equal strings share a key wherever
they are. A maximal run of strings with one key (LONG at most) is a phrase; neighbouring phrases overlap by
WIDTH - 1 bytes. Only keys that two documents share matter, and copies of a phrase need indexing once (as in
prefix-free parsing). The distinct phrases of a hash part, each with the first document that holds it, are indexed,
a range of keys of about BLOCK bytes at a time: a run-length compressed Burrows-Wheeler transform of their strings
with a sample of the document at the end of each run (RunLengthIndex). Phrases are then streamed against it from
right to left, one step over the runs a byte, and give their matching statistics cut off at WIDTH: for each string,
the sampled document of the first run that holds it. Where that one is earlier, the string's bytes go.

Steps, each a Spark shuffle of packed arrays:
  1. documents send their keys to hash parts; parts answer with the keys of several documents. A key that one
     batch of documents already shares is answered there and sent once, so a very common key costs its part one
     entry a batch.
  2. documents send the phrases of shared keys, each distinct phrase of a batch once. A key's batches tell how many
     distinct phrases they hold; keys that are hot (over HOT in all) are sent as single strings under a hash of
     their own, which spreads them over all parts.
  3. parts index their phrases and answer with spans; documents drop the bytes that spans cover.

Defined cases: a null text is empty; texts under WIDTH bytes are kept whole; a null doc_id comes before all
others; rows that share a doc_id never match each other but are each judged against smaller ids; a repeated row
is judged like the first; very long texts are treated whole; a string that several phrases hold belongs to the least
document; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, mix64, ragged, sliced, stored

WIDTH, GRAM = 50, 16
#: Phrases under one key, counted once a batch, from which it is hot: some 160 KB, so that a key fits in a block.
HOT = 2000
#: Bytes of text that a task condenses at a time; the more, the fewer copies of a key or phrase are sent.
BATCH = 32 << 20
#: Bytes of text that one hash part is made for, and bytes of phrases that are indexed at a time.
PART_BYTES, BLOCK = 8 << 20, 1 << 20
#: Strings of a phrase at most; longer ones are cut.
LONG = 256
#: Phrases that a task holds as Python values before it sends them.
FLUSH = 200_000
FIRST_ID = -(1 << 63)
_SPAN = WIDTH - GRAM + 1
_rng = np.random.default_rng(50)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_CODES = {c: np.dtype(d) for c, d in zip(b"ilIHB", ("<i8", "<i4", "<u4", "<u2", "u1"), strict=True)} | {ord("U"): np.dtype("<u8")}
_CODE_OF = {d: bytes([c]) for c, d in _CODES.items()}


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value."""
    arrays = [a.astype(a.dtype.newbyteorder("<"), copy=False) for a in arrays]
    head = b"".join(_CODE_OF[a.dtype] + len(a).to_bytes(6, "little") for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(bytes([len(arrays)]) + head + b"".join(a.tobytes() for a in arrays))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, out = data[0], []
    at = 1 + 7 * n
    for k in range(n):
        kind, size = _CODES[data[1 + 7 * k]], int.from_bytes(data[2 + 7 * k : 8 + 7 * k], "little")
        out.append(np.frombuffer(data, kind, size, at))
        at += size * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type for values that are not negative."""
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position."""
    h, step = _BYTE[data], 1
    for m in _M:  # grams of 2, 4, 8 and 16 bytes
        h = h[:-step] * m + h[step:]
        step *= 2
    return h


def marks(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A mark of each phrase's bytes, to count distinct ones: six grams cover all bytes of a phrase whose key's gram does not recur (84 bytes at most)."""
    out, reach = np.zeros(len(first), np.uint64), last - first + WIDTH - GRAM
    for j in range(6):
        out = mix64(out + h[first + reach * j // 5])
    return out


def runs(data: np.ndarray, doc: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated documents (doc: number of each byte's document): key, first and last string start of each phrase."""
    n = len(data) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    low, step = mix64(gram_hashes(data) if h is None else h), 1
    while step * 2 <= _SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n], low[_SPAN - step : _SPAN - step + n])
    inside = doc[:n] == doc[WIDTH - 1 :]
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(low[1:], low[:-1], out=starts[1:])
    starts[1:] |= inside[1:] != inside[:-1]
    starts[1:] |= doc[1:n] != doc[: n - 1]
    first = np.flatnonzero(starts)
    last = np.append(first[1:], n) - 1
    good = inside[first]
    first, last = first[good], last[good]
    if len(first) and (last - first).max() >= LONG:
        n = (last - first) // LONG + 1
        first, end = np.repeat(first, n) + LONG * ragged(np.zeros(len(n), np.int64), n), np.repeat(last, n)
        last = np.minimum(first + LONG - 1, end)
    return low[first], first, last


def chunks(texts: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, number of each byte's text within the chunk, text starts) of groups of texts."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= limit):
            size += len(texts[b])
            b += 1
        lens = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        yield a, np.frombuffer(b"".join(texts[a:b]), np.uint8), np.repeat(np.arange(b - a, dtype=np.int32), lens), np.cumsum(lens) - lens
        a = b


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return (keys % np.uint64(n_parts)).astype(np.int64)


def check_of(keys: np.ndarray) -> np.ndarray:
    """32 further bits of a key; a chance agreement costs a phrase sent in vain, never a wrong span."""
    return (mix64(keys) >> np.uint64(32)).astype(np.uint32)


def _slices(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of runs in a sorted array."""
    if not len(values):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
    return list(zip(values[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _decoded(column: pa.Array) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(x) for x in column.to_pylist()]


def packed_rows(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least), tk (a checksum that tells rows of one doc_id apart) and the compressed text."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        z = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array([z.compress((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "tk", "z"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc_id"), F.hash("text").alias("tk"), "text")
    return map_batches(rows, fn, "doc_id long, tk int, z binary")


def phrase_counts(key: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Distinct phrases of each distinct key; keys are sorted."""
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    group = np.cumsum(lead) - 1
    size = np.bincount(group, minlength=int(lead.sum()))
    out = np.ones(len(size), np.int64)
    several = size[group] > 1
    group, mark = group[several], mark[several]
    order = np.lexsort((mark, group))
    group, mark = group[order], mark[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (mark[1:] != mark[:-1])
    return np.maximum(out, np.bincount(group[fresh], minlength=len(size)))


def send_keys(docs: DataFrame, n_parts: int) -> DataFrame:
    """(part, doc_part, blob): keys to ask about (doc_part null), and answers that a batch gives itself."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_numpy()
        own: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, data, doc, _ in chunks([(x or "").encode() for x in batch.column("text").to_pylist()]):
            h = gram_hashes(data) if len(data) >= WIDTH else None
            key, first, last = runs(data, doc, h)
            own.append((key, doc[first] + a, marks(h, first, last) if len(first) else key))
        key, at, mark = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.lexsort((ids[at], key))
        key, who = key[order], ids[at][order]
        weight = phrase_counts(key, mark[order])
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
        key, who = key[fresh], who[fresh]
        lead = np.ones(len(key), bool)
        lead[1:] = key[1:] != key[:-1]
        several = np.zeros(len(key), bool)
        several[:-1] |= ~lead[1:]
        several |= ~lead
        parts, doc_parts, blobs = [], [], []
        ask, asker, shared = key[lead], who[lead], several[lead]
        part = part_of(ask, n_parts)
        order = np.lexsort((asker, part))
        for p, a, b in _slices(part[order]):
            o = order[a:b]
            parts.append(p)
            doc_parts.append(None)  # steps between sorted ids may pass 2**63 (FIRST_ID): unsigned, and added modulo 2**64
            blobs.append(pack(check_of(ask[o]), asker[o][:1], narrow(np.diff(asker[o], prepend=asker[o][:1]).view(np.uint64)), shared[o].astype("u1"), narrow(weight[o])))
        for p, d, blob in _answers(part_of(key[several], n_parts), check_of(key[several]), who[several], n_parts):
            parts.append(p)
            doc_parts.append(d)
            blobs.append(blob)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(doc_parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "doc_part", "blob"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("doc_id"), "text")
    return map_batches(rows, fn, "part int, doc_part int, blob binary", BATCH)


def _doc_part(ids: np.ndarray, n_parts: int) -> np.ndarray:
    return part_of(mix64(ids.view(np.uint64)), n_parts)


def _answers(part: np.ndarray, check: np.ndarray, ids: np.ndarray, n_parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Answers by the part of their documents: part and check of each shared key."""
    if not len(ids):
        return
    where = _doc_part(ids, n_parts)
    order = np.lexsort((ids, where))
    for d, a, b in _slices(where[order]):
        o = order[a:b]
        yield int(part[o[0]]), d, pack(ids[o], part[o].astype(np.uint32), check[o])


def answer_keys(asked: DataFrame, n_parts: int, hot_size: int = HOT) -> DataFrame:
    """(doc_part, blob): for documents, the keys that others hold too."""

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = key[0].as_py()
        checks, ids, known, weights, out = [], [], [], [], []
        for batch in batches:
            for d, blob in zip(batch.column("doc_part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if d is not None:
                    out.append((d, blob))
                    continue
                check, base, delta, shared, weight = unpack(blob)
                checks.append(check)
                ids.append(base[0] + np.cumsum(delta.astype(np.int64)))
                known.append(shared)
                weights.append(weight.astype(np.int64))
        if checks:
            check, who, shared, weight = (np.concatenate(x) for x in (checks, ids, known, weights))
            order = np.lexsort((who, check))
            check, who, shared, weight = check[order], who[order], shared[order], weight[order]
            lead = np.ones(len(check), bool)
            lead[1:] = check[1:] != check[:-1]
            starts = np.flatnonzero(lead)
            size = np.diff(np.append(starts, len(check)))
            several = (who[starts] != who[starts + size - 1]) | (np.maximum.reduceat(shared, starts) > 0)
            hit = np.repeat(several, size)
            out += [(d, blob) for _, d, blob in _answers(np.full(int(hit.sum()), p), check[hit], who[hit], n_parts)]
            if len(hot := check[starts[several & (np.add.reduceat(weight, starts) > hot_size)]]):  # every document that has them must know
                told = pack(np.empty(0, np.int64), np.full(len(hot), p, np.uint32), hot)
                out += [(d, told) for d in range(n_parts)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["doc_part", "blob"])

    return asked.groupBy("part").applyInArrow(answer, "doc_part int, blob binary")


def keys_by_document(answers: DataFrame) -> DataFrame:
    """(doc_id, keys): a document's shared keys, packed."""

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(b) for batch in batches for b in batch.column("blob").to_pylist()]
        mine = [x for x in found if len(x[0])]
        if not mine:
            return
        told = [x[1].astype(np.uint64) << np.uint64(32) | x[2] for x in found if not len(x[0])]
        ids, part, check = (np.concatenate(x) for x in zip(*mine, strict=True))
        full = part.astype(np.uint64) << np.uint64(32) | check
        order = np.lexsort((full, ids))
        ids, full = ids[order], full[order]
        hot = np.isin(full, np.concatenate(told)).astype("u1") if told else np.zeros(len(full), "u1")
        out = [(d, pack(full[a:b], hot[a:b])) for d, a, b in _slices(ids)]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["doc_id", "keys"])

    return answers.groupBy("doc_part").applyInArrow(gather, "doc_id long, keys binary")


def send_phrases(rows: DataFrame, n_parts: int) -> DataFrame:
    """(part, doc_part, blob) from (doc_id, tk, z, keys): distinct phrases of shared keys by part, and spans that a batch settles itself."""

    def message(sent: list[tuple], settled: list[tuple]) -> pa.RecordBatch:
        parts, doc_parts, blobs = [], [], []
        if sent:
            own = np.array([x[0] for x in sent], np.uint64)
            part = part_of(own, n_parts)
            by_part = np.argsort(part, kind="stable")
            docs, tk, start = (np.array([x[i] for x in sent], t) for i, t in ((1, np.int64), (2, np.int32), (3, np.int64)))
            lens = np.array([len(x[4]) for x in sent])
            for p, lo, hi in _slices(part[by_part]):
                o = by_part[lo:hi]
                parts.append(p)
                doc_parts.append(None)
                blobs.append(pack(own[o], docs[o], tk[o], narrow(start[o]), narrow(lens[o]), np.frombuffer(b"".join(sent[i][4] for i in o.tolist()), np.uint8)))
        if settled:
            for p, d, blob in _spans(*(np.array(x) for x in zip(*settled, strict=True)), n_parts):
                parts.append(p)
                doc_parts.append(d)
                blobs.append(blob)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(doc_parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "doc_part", "blob"])

    def messages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, tks = batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist()
        asked = batch.column("keys").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        all_texts = _decoded(batch.column("z"))
        texts = [all_texts[k] for k in order]
        first_of: dict[bytes, int] = {}  # phrase to its least doc_id among those not yet sent
        sent, settled = [], []
        for a, data, doc, begins in chunks(texts):
            key, first, last = runs(data, doc)
            where = doc[first]
            full = part_of(key, n_parts).astype(np.uint64) << np.uint64(32) | check_of(key)
            for d, lo, hi in _slices(where):
                k = order[a + d]
                mine, hot = unpack(asked[k])
                at = np.minimum(np.searchsorted(mine, full[lo:hi]), len(mine) - 1)
                hit = np.flatnonzero(mine[at] == full[lo:hi])
                text, begin = texts[a + d], begins[d]
                for j, is_hot in zip((hit + lo).tolist(), (hot[at[hit]] > 0).tolist(), strict=True):
                    s, e = int(first[j] - begin), int(last[j] - begin)
                    for s, e in [(x, x) for x in range(s, e + 1)] if is_hot else [(s, e)]:  # noqa: PLW2901
                        phrase = text[s : e + WIDTH]
                        if first_of.setdefault(phrase, ids[k]) < ids[k]:
                            settled.append((ids[k], tks[k], s, e + WIDTH))
                        else:
                            own = int.from_bytes(hashlib.blake2b(phrase, digest_size=8).digest(), "little") if is_hot else int(key[j])
                            sent.append((own, ids[k], tks[k], s, phrase))
                    if len(sent) + len(settled) >= FLUSH:
                        yield message(sent, settled)
                        sent, settled, first_of = [], [], {}
        if sent or settled:
            yield message(sent, settled)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, BATCH // 3):
                yield from messages(part)

    return rows.mapInArrow(fn, "part int, doc_part int, blob binary")


def _spans(ids: np.ndarray, tk: np.ndarray, begin: np.ndarray, end: np.ndarray, n_parts: int) -> Iterator[tuple[int, int, bytes]]:
    """Spans by the part of their documents."""
    where = _doc_part(ids.astype(np.int64), n_parts)
    order = np.lexsort((begin, tk, ids, where))
    for d, a, b in _slices(where[order]):
        o = order[a:b]
        yield d, d, pack(ids[o].astype(np.int64), tk[o].astype(np.int32), narrow(begin[o]), narrow(end[o] - begin[o]))


class RunLengthIndex:
    """The WIDTH-byte strings of phrases in sorted order, as a run-length compressed Burrows-Wheeler transform.

    Rows are the strings of all phrases; equal strings lie in the order of the phrases' first documents. A step (LF)
    leads from a row to that of the string one byte further left in its phrase. A run is a stretch of rows of one
    string with one byte before it (its head) whose steps lead to neighbouring rows, so a step inside it is known
    from its first row alone. Per run: first (its first row), heads, to (where its first row steps to), samples (the
    document at its first end, the least inside it) and lead (the first run of its string). Rows themselves are not kept.
    """

    def __init__(self, phrases: list[bytes], first_docs: np.ndarray):
        by_doc = np.argsort(first_docs, kind="stable")
        lens = np.fromiter((len(phrases[i]) for i in by_doc.tolist()), np.int64, len(phrases))
        self.text = text = np.frombuffer(b"".join(phrases[i] for i in by_doc.tolist()), np.uint8)
        starts = np.cumsum(lens) - lens
        n_strings = lens - WIDTH + 1
        at = ragged(starts, n_strings)  # where each string starts, phrase by phrase
        row = self._rows(text, at, ragged(starts, lens - 7), ragged(starts, lens - 23))
        order = np.empty(len(at), np.int64)
        order[row] = np.arange(len(at))
        key, lead = self._key[order], np.ones(len(at), bool)
        lead[1:] = key[1:] != key[:-1]
        del self._key
        begins = np.cumsum(n_strings) - n_strings
        is_first = np.zeros(len(at), bool)
        is_first[begins] = True
        is_first = is_first[order]
        step = np.where(is_first, -1, row[order - 1])
        bwt = np.where(is_first, 256, text[at[order] - 1]).astype(np.int16)  # 256: the phrase begins here
        new = lead.copy()
        new[1:] |= (bwt[1:] != bwt[:-1]) | (~is_first[1:] & (step[1:] != step[:-1] + 1))
        self.first = np.flatnonzero(new)
        self.heads, self.to = bwt[self.first], step[self.first]
        self.samples = np.repeat(first_docs[by_doc], n_strings)[order[self.first]]
        self.lead = np.maximum.accumulate(np.where(lead[self.first], np.arange(len(self.first)), 0))
        # Where each phrase is entered, and where its strings go in the order in which phrases were given.
        self.n_rows, self.n_strings, self.last_row, self.last_at = len(at), n_strings, row[begins + n_strings - 1], at[begins + n_strings - 1]
        given = np.empty(len(phrases), np.int64)
        given[by_doc] = n_strings
        self.of_phrase = np.repeat(np.arange(len(phrases)), given)
        self.last_out = (np.cumsum(given) - 1)[by_doc]

    def _rows(self, text: np.ndarray, at: np.ndarray, at8: np.ndarray, at24: np.ndarray) -> np.ndarray:
        """The row of each string, from ranks of 8 and 24 bytes; equal strings keep their order."""
        word = np.zeros(len(at8), np.uint64)
        for k in range(8):
            word = word << np.uint64(8) | text[at8 + k]
        rank = np.zeros(len(text), np.uint32)
        rank[at8] = self._ranks(word)
        wide = np.zeros(len(text), np.uint32)
        wide[at24] = self._ranks(self._joined(rank[at24], rank[at24 + 8], rank[at24 + 16]))
        self._key = self._joined(wide[at], wide[at + 24], wide[at + WIDTH - 24])
        row = np.empty(len(at), np.int64)
        row[np.argsort(self._key, kind="stable")] = np.arange(len(at))
        return row

    @classmethod
    def _joined(cls, *ranks: np.ndarray) -> np.ndarray:
        """Keys that sort like the three ranks one after the other."""
        a, b, c = (x.astype(np.uint64) for x in ranks)
        if max(int(x.max(initial=0)) for x in ranks) < 1 << 21:
            return a << np.uint64(42) | b << np.uint64(21) | c
        return cls._ranks(a << np.uint64(32) | b).astype(np.uint64) << np.uint64(32) | c

    @staticmethod
    def _ranks(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values)
        same = values[order]
        rank = np.empty(len(values), np.uint32)
        rank[order] = np.cumsum(np.concatenate([[0], same[1:] != same[:-1]]))[: len(values)]
        return rank

    def earliest(self) -> np.ndarray:
        """For each string of each phrase, in text order, the least first document that holds it.

        All phrases are streamed side by side from their last string to their first, a step over the runs a byte.
        """
        out = np.empty(self.n_rows, np.int64)
        longest = np.argsort(-self.n_strings, kind="stable")
        row, at, to, left = self.last_row[longest], self.last_at[longest], self.last_out[longest], self.n_strings[longest]
        while len(row):
            run = np.searchsorted(self.first, row, side="right") - 1
            out[to] = self.samples[self.lead[run]]
            n = int(np.searchsorted(-left, -1, side="left"))  # phrases with strings further left
            run, row, at, to, left = run[:n], row[:n], at[:n], to[:n] - 1, left[:n] - 1
            if (self.heads[run] != self.text[at - 1]).any():
                raise ValueError("a run's head is not the byte before its string")
            row, at = self.to[run] + row - self.first[run], at - 1
        return out


def _key_ranges(key: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Phrases in blocks of about BLOCK bytes that never part the phrases of a key; a phrase alone under its key shares no string."""
    order = np.argsort(key, kind="stable")
    cuts = _slices(key[order])
    block, held = [], 0
    for _, a, b in cuts:
        if b - a < 2:
            continue
        block.append(order[a:b])
        held += int(size[order[a:b]].sum())
        if held >= BLOCK:
            yield np.concatenate(block)
            block, held = [], 0
    if block:
        yield np.concatenate(block)


def settle(sent: DataFrame, n_parts: int) -> DataFrame:
    """(doc_part, blob): spans of the phrases' strings that an earlier document holds."""

    def fn(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, found = [], []
        for batch in batches:
            for d, blob in zip(batch.column("doc_part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if d is not None:
                    out.append((d, blob))
                else:
                    found.append(unpack(blob))
        if found:
            own, ids, tk, begin, lens = (np.concatenate([x[i].astype(t) for x in found]) for i, t in enumerate((np.uint64, np.int64, np.int32, np.int64, np.int64)))
            number: dict[bytes, int] = {}
            phrase = np.empty(len(ids), np.int64)
            k = 0
            for x in found:
                data, at = x[5].tobytes(), 0
                for size in x[4].tolist():
                    phrase[k] = number.setdefault(data[at : at + size], len(number))
                    at += size
                    k += 1
            phrases = list(number)
            first = np.full(len(phrases), np.iinfo(np.int64).max)
            np.minimum.at(first, phrase, ids)
            spans = []
            later = ids > first[phrase]
            if later.any():
                spans.append((ids[later], tk[later], begin[later], begin[later] + lens[later]))
            # Other strings of a phrase's first documents: streamed against the index of the phrases under the same keys.
            key_of = np.empty(len(phrases), np.uint64)
            key_of[phrase] = own
            own_rows = np.flatnonzero(~later)
            own_rows = own_rows[np.argsort(phrase[own_rows], kind="stable")]
            bounds = np.searchsorted(phrase[own_rows], np.arange(len(phrases) + 1))
            for use in _key_ranges(key_of, np.fromiter(map(len, phrases), np.int64, len(phrases))):
                index = RunLengthIndex([phrases[i] for i in use.tolist()], first[use])
                hit = np.flatnonzero(index.earliest() < first[use][index.of_phrase])
                if not len(hit):
                    continue
                of = index.of_phrase[hit]
                place = hit - np.searchsorted(index.of_phrase, of)
                cut = np.ones(len(hit), bool)  # neighbouring strings make one span
                cut[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)
                a = np.flatnonzero(cut)
                b = np.append(a[1:], len(hit)) - 1
                p, lo, hi = use[of[a]], place[a], place[b] + WIDTH
                n = bounds[p + 1] - bounds[p]
                row = own_rows[ragged(bounds[p], n)]
                spans.append((ids[row], tk[row], begin[row] + np.repeat(lo, n), begin[row] + np.repeat(hi, n)))
            if spans:
                out += [(d, blob) for _, d, blob in _spans(*(np.concatenate(x) for x in zip(*spans, strict=True)), n_parts)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["doc_part", "blob"])

    return sent.groupBy("part").applyInArrow(fn, "doc_part int, blob binary")


def spans_by_document(answers: DataFrame) -> DataFrame:
    """(doc_id, tk, spans): maximal removed runs of each row that loses bytes, packed."""

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpack(b) for batch in batches for b in batch.column("blob").to_pylist()]
        ids, tk, begin, size = (np.concatenate([x[i].astype(t) for x in found]) for i, t in enumerate((np.int64, np.int32, np.int64, np.int64)))
        order = np.lexsort((begin, tk, ids))
        ids, tk, begin, end = ids[order], tk[order], begin[order], (begin + size)[order]
        rows = np.ones(len(ids), bool)
        rows[1:] = (ids[1:] != ids[:-1]) | (tk[1:] != tk[:-1])
        group = np.cumsum(rows) - 1
        lift = group * (int(end.max()) + 2)  # documents one after the other on one line
        begin, reach = begin + lift, np.maximum.accumulate(end + lift)
        cut = np.ones(len(ids), bool)
        cut[1:] = begin[1:] > reach[:-1]
        a = np.flatnonzero(cut)
        b = np.append(a[1:], len(ids)) - 1
        lo, hi = begin[a] - lift[a], reach[b] - lift[a]
        out = [(int(ids[a[x]]), int(tk[a[x]]), pack(lo[x:y], hi[x:y])) for _, x, y in _slices(group[a])]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["doc_id", "tk", "spans"])

    return answers.groupBy("doc_part").applyInArrow(gather, "doc_id long, tk int, spans binary")


def repeated_spans(docs: DataFrame, hot_size: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Packed rows of docs, and (doc_id, tk, spans) of those with bytes to remove."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    keys = keys_by_document(answer_keys(send_keys(docs, n_parts), n_parts, hot_size))
    rows = packed_rows(docs)
    sent = send_phrases(rows.join(keys, "doc_id"), n_parts)
    return rows, stored(spans_by_document(settle(sent, n_parts)), "spans")


def cut(text: bytes, spans: bytes | None) -> tuple[bytes, int]:
    """What is left of a text, and how many runs went."""
    if spans is None:
        return text, 0
    lo, hi = unpack(spans)
    edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(lo)


def removal_digest(docs: DataFrame, hot_size: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, spans = repeated_spans(docs, hot_size)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(4)]
        for text, span in zip(_decoded(batch.column("z")), batch.column("spans").to_pylist(), strict=True):
            left, n = cut(text, span)
            for column, value in zip(out, (len(text), len(text) - len(left), n, hashlib.sha256(left).hexdigest()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = map_batches(rows.join(spans, ["doc_id", "tk"], "left"), fn, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != FIRST_ID, F.col("doc_id")).cast(kind))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with the repeated bytes gone from text; a character that a span cuts through goes whole."""
    _, spans = repeated_spans(docs)
    columns = docs.columns
    keyed = docs.withColumns({"__row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)), "__row_tk": F.hash("text")})
    joined = keyed.join(spans.select(F.col("doc_id").alias("__row_id"), F.col("tk").alias("__row_tk"), "spans"), ["__row_id", "__row_tk"], "left").select(*docs.columns, F.col("spans").alias("__spans"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x if s is None else cut(x.encode(), s)[0].decode(errors="ignore") for x, s in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], columns)

    return map_batches(joined, fn, docs.schema)


def op7_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(documents(spark, sf_dir))
