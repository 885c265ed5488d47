"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts and items are compared in lower case, with every run of ASCII characters other than letters and digits as
one space. An item of m bytes with an edit budget of e shares at least m - q + 1 - q * e of its q-grams with
any region that it aligns to within the budget (the q-gram lemma), and these lie within e neighbouring
diagonals. Diagonals are dealt into overlapping bands, two for each diagonal; a band whose count meets the bound
is aligned, inside the band only, and kept if its edits are within the budget. Bands are aligned side by side, first
the last half of their items, which most chance candidates (items with a common beginning) don't survive. q is 8, and 4 for items so short
that their budget would leave no 8-gram whole.

The items are the stated query set: they are held against all documents in blocks of at most about BLOCK_BYTES,
so that what is shipped to tasks is bounded; every block costs one pass over the documents. With several blocks each
one's matches are written before the next block is read, so the driver holds one block at a time.

Defined cases: null, empty and blank texts match nothing; items shorter than Q bytes (their budget is
0 edits) are found as exact words only; equal matches of an item in a text are one row, with the least edits and
then the first end; very long texts are searched whole; items that repeat are each reported; a null item_id is reported as null; rows that repeat are each
reported; a null doc_id is kept; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, map_batches, ragged, stored

#: Bytes of a q-gram, for items that are long enough for the lemma to bound anything (m - q + 1 - q * e >= 1), and for shorter ones.
Q, SHORT_Q = 8, 4
#: Edits allowed as a share of the item's bytes.
BUDGET = 0.1
BLOCK_BYTES = 4 << 20
_FOLD = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)], np.uint8)
_TABLE_BITS = 20
#: Shared q-grams (text position and item place) that are counted at a time, and cells of bands that are aligned at a time.
PAIRS, CELLS = 1 << 22, 1 << 21
#: More edits than any budget that is counted in 16 bits; wider bands take 32.
_FAR = 1 << 14


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of the texts, each followed by a zero byte, and where each starts."""
    raw = [x.lower().encode() for x in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    data = _FOLD[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    ends = np.cumsum(lens + 1) - 1
    data[ends] = 0
    blank = data == 32
    drop = np.zeros(len(data), bool)
    drop[1:] = blank[1:] & (blank[:-1] | (data[:-1] == 0))  # second and later blanks, and a text's first
    drop[0] = blank[0]
    drop[:-1] |= blank[:-1] & (data[1:] == 0)
    kept = np.cumsum(~drop)
    starts = np.concatenate([[0], kept[ends[:-1]]]) if len(texts) else np.zeros(0, np.int64)
    return data[~drop], starts


def codes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """The q (4 or 8) bytes at each position as one number."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    c, step = data.astype(np.uint64), 1
    while step < q:
        c = (c[:-step] << np.uint64(8 * step)) | c[step:]
        step *= 2
    return c


def _slot(c: np.ndarray) -> np.ndarray:
    return ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class Grams:
    """The q-grams of a block's items of one q, with all their places."""

    def __init__(self, items: "Items", data: np.ndarray, starts: np.ndarray, q: int):
        self.q = q
        own = (items.q == q) & (items.m >= Q)
        self.least = int(items.least[own].min(initial=1 << 40))
        n = np.where(own, items.m - q + 1, 0)
        place = ragged(np.zeros(len(n), np.int64), n)
        item = np.repeat(np.arange(len(n)), n)
        c = codes(data, q)[starts[item] + place] if len(place) else np.empty(0, np.uint64)
        order = np.argsort(c, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.count = np.unique(c[order], return_index=True, return_counts=True)
        self.n_items = len(n)
        self.ranked = np.repeat(np.arange(len(self.codes)), self.count) * self.n_items + self.item  # ascending: code, then item
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.codes)] = True

    def places(self, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For each code (by number) where the places of items low to high - 1 start, and how many there are."""
        if low == 0 and high == self.n_items:
            return self.first[at], self.count[at]
        a = np.searchsorted(self.ranked, at * self.n_items + low)
        return a, np.searchsorted(self.ranked, at * self.n_items + high) - a


class Items:
    """A block of items: budgets, thresholds, band widths and q-grams."""

    def __init__(self, ids: list, texts: list[str], budget: float = BUDGET):
        data, starts = normal(texts)
        ends = np.append(starts[1:], len(data)) - 1
        self.ids = ids
        self.items = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        self.data, self.starts = data, starts
        self.m = (ends - starts).astype(np.int64)
        self.e = (self.m * budget).astype(np.int64)
        self.q = np.where(self.m - Q + 1 - Q * self.e >= 1, Q, SHORT_Q)
        self.least = self.m - self.q + 1 - self.q * self.e
        if ((self.m >= Q) & (self.least < 1)).any():
            raise ValueError("a budget under which an item need not share any q-gram")
        self.width = self.e + 1
        self.short = [k for k in range(len(ids)) if 0 < self.m[k] < Q]
        self.grams = [Grams(self, data, starts, q) for q in (Q, SHORT_Q)]

    def aligned(self, data: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidate bands (text, item, first start diagonal): which are within the budget, their least edits, and where the first such alignment ends."""
        begin = np.maximum(low - self.e[item], 0)
        size = low + 2 * self.width[item] + self.e[item] - begin + 1
        able = np.flatnonzero(size > 0)  # others would start before the text
        able = able[np.lexsort((self.m[item[able]], size[able]))]
        kept, edits, ends = [], [], []
        a = 0
        while a < len(able):
            # Bands of like sizes: the widest of a chunk is at most twice its first.
            room = max(CELLS // int(size[able[a]]) // 2, 1)
            b = min(a + room, int(np.searchsorted(size[able], 2 * size[able[a]], side="right")))
            use, a = able[a:b], b
            for half in (True, False):
                if not len(use):
                    break
                k, t = item[use], text[use]
                good, least, diagonal = self._edits(data, bounds[t], bounds[t + 1] - 1 - bounds[t], k, begin[use], size[use], half)
                use = use[good]
            if not len(use):
                continue
            kept.append(use)
            edits.append(least)
            ends.append(np.minimum(begin[use] + self.m[item[use]] + diagonal, bounds[text[use] + 1] - 1 - bounds[text[use]]))
        if not kept:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(kept), np.concatenate(edits), np.concatenate(ends)

    def _edits(self, data: np.ndarray, origin: np.ndarray, n: np.ndarray, item: np.ndarray, begin: np.ndarray, size: np.ndarray, half: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands side by side, a row an item's byte: which are within the budget, least edits and first diagonal of these.

        half: the last halves of the items only, from the end backward; a band over the budget there is over it in all.
        """
        m, e = self.m[item], self.e[item]
        rows = m - m // 2 if half else m
        top, wide = int(rows.max()), int(size.max())
        sign = -1 if half else 1
        start = begin + m + size - 2 if half else begin
        kind = np.int16 if wide + top < _FAR else np.int32
        alive = np.arange(len(item))
        good, least, diagonal = np.zeros(len(item), bool), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        ramp = np.arange(wide, dtype=kind)[:, None]
        outside = np.where(ramp >= size, _FAR if kind is np.int16 else 1 << 29, 0).astype(kind)
        cur = outside.copy()
        for i in range(top):
            if i % 16 == 0:  # the text's bytes that the next rows meet; past its ends it is zero
                at = start + sign * (i + np.arange(wide + min(16, top - i)))[:, None]
                window = np.where((at >= 0) & (at < n), data[np.clip(origin + at, 0, len(data) - 1)], 0).astype(np.uint8)
            byte = self.data[np.minimum(self.starts[item] + (m - 1 - i if half else i), len(self.data) - 1)]
            new = cur + (window[i % 16 : i % 16 + wide] != byte)
            np.minimum(new[:-1], cur[1:] + kind(1), out=new[:-1])
            new -= ramp
            np.minimum.accumulate(new, axis=0, out=new)
            new += ramp
            cur = np.maximum(new, outside)
            best = cur.min(axis=0)
            done = rows == i + 1
            if done.any():
                fit = done & (best <= e)
                good[alive[fit]], least[alive[fit]], diagonal[alive[fit]] = True, best[fit], cur[:, fit].argmin(axis=0)
            stay = ~done & (best <= e)
            if not stay.any():
                break
            if (i % 16 == 15 and not stay.all()) or stay.sum() * 2 < len(stay) or done.any():
                alive, item, m, e, rows, n, origin, start, size = (x[stay] for x in (alive, item, m, e, rows, n, origin, start, size))
                cur, outside, window = cur[:, stay], outside[:, stay], window[:, stay]
        return good, least[good], diagonal[good]

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, end in the normalised text) of every text and item that match, by the least edits."""
        data, starts = normal(texts)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        bounds = np.append(starts, len(data))
        for grams in self.grams:
            self._search(grams, data, bounds, found)
        for k in self.short:
            for t in range(len(texts)):
                own = b" " + data[bounds[t] : bounds[t + 1] - 1].tobytes() + b" "
                if (p := own.find(b" " + self.items[k] + b" ")) >= 0:
                    found[t, k] = (0, p + len(self.items[k]))
        return [(t, k, *v) for (t, k), v in sorted(found.items())]

    def _search(self, grams: Grams, data: np.ndarray, bounds: np.ndarray, found: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds to found (text, item): the least edits and where they end."""
        if not len(grams.codes):
            return
        starts = bounds[:-1]
        c = codes(data, grams.q)
        hit = np.flatnonzero(grams.table[_slot(c)])
        at = np.minimum(np.searchsorted(grams.codes, c[hit]), len(grams.codes) - 1)
        good = grams.codes[at] == c[hit]
        hit, at = hit[good], at[good]
        if not len(hit):
            return
        text = np.searchsorted(starts, hit, side="right") - 1
        # A text needs as many hits as the least demanding item.
        enough = np.bincount(text, minlength=len(starts))[text] >= grams.least
        hit, at, text = hit[enough], at[enough], text[enough]
        # Whole texts together, as many as share PAIRS grams with the items; a text with more meets the items in groups.
        edges = np.flatnonzero(np.diff(text, prepend=-1))
        load = np.add.reduceat(grams.count[at], edges) if len(edges) else np.empty(0, np.int64)
        edges, a = np.append(edges, len(text)), 0
        while a < len(load):
            b = max(a + 1, int(np.searchsorted(np.cumsum(load[a:]), PAIRS, side="right")) + a)
            own = slice(edges[a], edges[b])
            groups = min(-(-int(load[a:b].sum()) // PAIRS), len(self.ids))
            cuts = [len(self.ids) * g // groups for g in range(groups + 1)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                self._bands(grams, data, bounds, hit[own], at[own], text[own], low, high, found)
            a = b

    def _bands(self, grams: Grams, data: np.ndarray, bounds: np.ndarray, hit: np.ndarray, at: np.ndarray, text: np.ndarray, first: int, after: int, found: dict[tuple[int, int], tuple[int, int]]) -> None:
        """Adds to found what the bands of items first to after - 1 hold."""
        begin, n = grams.places(at, first, after)
        o = ragged(begin, n)
        if not len(o):
            return
        item, text = grams.item[o], np.repeat(text, n)
        diagonal = np.repeat(hit, n) - bounds[text] - grams.place[o]
        top = int(self.m.max()) + 2
        band = (diagonal + top) // self.width[item]
        span = int(band.max(initial=0)) + 2
        key = (text * len(self.ids) + item) * span + band
        key, count = np.unique(key, return_counts=True)
        # A band has its own diagonals and those of the next one.
        total = count.copy()
        follows = np.flatnonzero(key[1:] == key[:-1] + 1)
        total[follows] += count[follows + 1]
        band, rest = key % span, key // span
        text, item = rest // len(self.ids), rest % len(self.ids)
        enough = total >= self.least[item]
        band, text, item = band[enough], text[enough], item[enough]
        kept, edits, ends = self.aligned(data, bounds, text, item, band * self.width[item] - top)
        for t, k, *match in zip(text[kept].tolist(), item[kept].tolist(), edits.tolist(), ends.tolist(), strict=True):
            found[t, k] = min(found.get((t, k), (1 << 62, 0)), tuple(match))


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about block_bytes the items make, by a hash of their text, and the blocks, each read when it is asked for."""
    rows = benchmark.select("item_id", "text").where("length(trim(text)) > 0")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    return n, (sorted(map(tuple, rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])) for b in range(n))


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, match_end (byte of the normalised text), contaminated (true): one row a document and item that match."""
    kinds = [f.dataType.simpleString() for f in (docs.schema["doc_id"], benchmark.schema["item_id"])]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, match_end long, contaminated boolean"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    n, blocks = item_blocks(benchmark, block_bytes)
    out = []
    for rows in blocks:
        items = Items([r[0] for r in rows], [r[1] for r in rows], budget)

        def fn(batch: pa.RecordBatch, items: Items = items) -> pa.RecordBatch | None:
            found = items.search([x or "" for x in batch.column("text").to_pylist()])
            if not found:
                return None
            ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int32()))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([items.ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64()), pa.array([True] * len(found))],
                ["doc_id", "item_id", "edits", "match_end", "contaminated"],
            )

        found = map_batches(docs.select("doc_id", "text"), fn, schema, 1 << 20)
        out.append(stored(found, "matches") if n > 1 else found)
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of docs, all columns, that match no item."""
    n, blocks = item_blocks(benchmark)
    if n > 1:  # several passes find the ids first; they are few
        hit = stored(matches(docs, benchmark, budget).select("doc_id").distinct(), "contaminated")
        return docs.join(hit, docs.doc_id.eqNullSafe(hit.doc_id), "left_anti")
    rows = next(blocks, [])
    items = Items([r[0] for r in rows], [r[1] for r in rows], budget) if rows else None

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        if items is not None:
            keep[[f[0] for f in items.search([x or "" for x in batch.column("text").to_pylist()])]] = False
        return batch.filter(pa.array(keep))

    return map_batches(docs, fn, docs.schema, 1 << 20)


def op10_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
