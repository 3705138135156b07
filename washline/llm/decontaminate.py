"""Benchmark decontamination: q-gram lemma in overlapping diagonal bands, verified by banded alignment.

A benchmark item is cut into segments of ``SEGMENT`` bytes (step ``STEP``; shorter
items are one segment), each with an edit budget of a tenth of its length. A
region of a document within e edits of a segment of length L shares at least
L + 1 - q(e + 1) q-grams with it, all on e + 1 neighbouring diagonals. So:

1. the q-grams of the items are held in a bit table; document positions that hit it
   are kept where a stretch of segment length has enough hits for any item;
2. kept hits are placed on their diagonal (position in the document minus position
   in the item) and counted, per segment, in bands of 2(e + 1) diagonals that overlap
   by half;
3. bands that reach the bound are verified: the segment is aligned with the document
   inside the band (edit distance, free ends in the document); alignments whose whole
   row is over the budget stop early.

Letters A-Z are lower-cased and white space counts as one blank sign; positions are
bytes of the document. Items travel to the tasks in blocks of at most
``BLOCK_BYTES`` of text, however many there are, and documents are never shuffled.

Defined results: null and empty texts and items match nothing, nor do items shorter
than q bytes; repeated documents and items are each reported; extra columns of the
documents are kept by ``clean``. A document shorter than a segment can only match
shorter items.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm import common as C
from washline.llm.jaccard import small

GRAM, SEGMENT, STEP, BUDGET = 8, 100, 20, 10
BLOCK_BYTES = 8 << 20
_BITS = 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[C.SPACE] = 32


def grams(buf: np.ndarray) -> np.ndarray:
    """The GRAM bytes at each position, as one number."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, C.U64)
    return np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(buf), strides=(1,)).astype(C.U64)


def _slot(g: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((g * C.U64(0x9E3779B97F4A7C15)) >> C.U64(64 - _BITS)).astype(np.int64)


class Items:
    """Lookup structures for one block of benchmark items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: list = []
        self.text: list = []
        for item, text in rows:
            raw = _FOLD[np.frombuffer((text or "").encode(), np.uint8)]
            if len(raw) >= GRAM:
                self.ids.append(item)
                self.text.append(raw)
        size = np.array([min(SEGMENT, len(t)) for t in self.text], np.int64)
        # the budget, cut for short items so that the lemma still asks for a shared q-gram
        self.edits = np.minimum(size // BUDGET, size // GRAM - 1)
        self.bound = size + 1 - GRAM * (self.edits + 1)
        self.size = size
        self.length = np.array([len(t) for t in self.text], np.int64)
        self.parts = -(-(self.length - size) // STEP) + 1         # segments start every STEP bytes, the last one at the end
        g = [grams(t) for t in self.text]
        values = np.concatenate(g) if g else np.zeros(0, C.U64)
        owner = np.repeat(np.arange(len(g)), [len(x) for x in g]).astype(np.int64)
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.place = values[order], owner[order], place[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[_slot(self.values)] = True

    def bands(self, buf: np.ndarray, off: np.ndarray):
        """(text row, item, segment, first diagonal of the band relative to the text) that reach the bound."""
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        g = grams(buf)
        if not len(g) or not len(self.values):
            return none
        hit = self.table[_slot(g)]
        for k in range(1, GRAM):       # no q-gram runs over the end of a text
            cut = off[1:] - k
            hit[cut[(cut >= 0) & (cut < len(hit))]] = False
        at = np.flatnonzero(hit)
        reach = int((self.size + self.edits).max())
        need = int(self.bound.min())
        inside = np.searchsorted(at, at + reach) - np.arange(len(at))     # hits in [p, p + reach)
        dense = np.zeros(len(at) + 1, np.int64)
        good = np.flatnonzero(inside >= need)
        np.add.at(dense, good, 1)
        np.add.at(dense, good + inside[good], -1)
        at = at[np.cumsum(dense[:-1]) > 0]
        left, right = np.searchsorted(self.values, g[at], "left"), np.searchsorted(self.values, g[at], "right")
        many = right - left
        if not many.sum():
            return none
        where = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pos, item, place = np.repeat(at, many), self.owner[where], self.place[where]
        row = np.searchsorted(off, pos, "right") - 1
        width = self.edits[item] + 1
        band = np.floor_divide(pos - off[row] - place, width)
        # a band holds diagonals [b * width, (b + 2) * width): each hit lies in two
        row, item, place, pos = (np.concatenate([x, x]) for x in (row, item, place, pos))
        band = np.concatenate([band, band - 1])
        keep, group = self._rich(((row * len(self.ids) + item) << 26) + band + (1 << 25), pos, item)
        row, item, band, pos, place, group = row[keep], item[keep], band[keep], pos[keep], place[keep], group[keep]
        if not len(row):
            return none
        # the same count for every segment that a hit lies in
        last = self.parts[item] - 1
        lo = np.minimum(np.maximum(-(-(place + GRAM - self.size[item]) // STEP), 0), last)
        hi = np.where(place >= self.length[item] - self.size[item], last, np.minimum(place // STEP, last - 1))
        many = np.maximum(hi - lo + 1, 0)
        part = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, item, band, pos, group = (np.repeat(x, many) for x in (row, item, band, pos, group))
        keep, _ = self._rich(group * int(self.parts.max()) + part, pos, item)
        row, item, part, band = row[keep], item[keep], part[keep], band[keep]
        order = np.lexsort((band, part, item, row))
        row, item, part, band = row[order], item[order], part[order], band[order]
        new = np.ones(len(row), bool)
        same = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (part[1:] == part[:-1])
        new[1:] = ~(same & (band[1:] == band[:-1]))
        row, item, part, band = row[new], item[new], part[new], band[new]
        # an alignment covers its band and the next one
        follows = np.zeros(len(row), bool)
        follows[1:] = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (part[1:] == part[:-1]) & (band[1:] == band[:-1] + 1)
        begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(row))))
        take = (np.arange(len(row)) - begin) % 2 == 0
        row, item, part, band = row[take], item[take], part[take], band[take]
        return row, item, part, band * (self.edits[item] + 1)

    def _rich(self, key: np.ndarray, pos: np.ndarray, item: np.ndarray):
        """(hits in groups of equal key with enough distinct positions, number of each hit's group)."""
        order = np.lexsort((pos, key))
        k, p = key[order], pos[order]
        new = np.ones(len(order), bool)
        new[1:] = k[1:] != k[:-1]
        fresh = new.copy()
        fresh[1:] |= p[1:] != p[:-1]
        group = np.cumsum(new) - 1
        shared = np.bincount(group, weights=fresh).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        number = np.empty(len(order), np.int64)
        number[order] = group
        return np.flatnonzero(shared[number] >= self.bound[item]), number

    def align(self, buf: np.ndarray, off: np.ndarray, row, item, part, diagonal):
        """Banded alignment of the candidates: (row, item, begin, end, edits) of those within budget."""
        out = []
        for size in np.unique(self.size[item]):
            of_size = np.flatnonzero(self.size[item] == size)
            for lo in range(0, len(of_size), 4096):
                c = of_size[lo:lo + 4096]
                first = np.minimum(part[c] * STEP, self.length[item[c]] - size)
                ok = self._distance(buf, off, row[c], item[c], diagonal[c], first, int(size), False)[0]
                c, first = c[ok], first[ok]
                if len(c):
                    begin, end, edits = self._distance(buf, off, row[c], item[c], diagonal[c], first, int(size), True)
                    out.append((row[c], item[c], begin, end, edits))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5

    def _distance(self, buf, off, row, item, diagonal, first, size, places):
        """Which candidates stay within the budget or, if they all do, (begin, end, edits) of each."""
        e = int(self.edits[item[0]])
        cols = 3 * (e + 1)                      # the diagonals of a band and of the next one
        low, high = off[row], off[row + 1]
        origin = low + diagonal + first
        text = np.stack([self.text[i][f:f + size] for i, f in zip(item, first)])
        offsets = np.arange(cols, dtype=np.int32)
        big = np.int32(1 << 20)
        alive = np.arange(len(row))
        dist = np.zeros((len(row), cols), np.int32)
        begin = np.broadcast_to(offsets, dist.shape).copy() if places else None
        for r in range(size):
            # cell j of row r is document position origin + r + j
            at = origin[alive, None] + r + offsets
            inside = (at >= low[alive, None]) & (at < high[alive, None])
            same = inside & (buf[np.minimum(np.maximum(at, 0), len(buf) - 1)] == text[alive, r:r + 1])
            new = np.where(inside, dist + ~same, big)
            skip = np.concatenate([dist[:, 1:] + 1, np.full((len(alive), 1), big)], axis=1)    # item byte without partner
            if places:
                src = np.where(skip < new, np.concatenate([begin[:, 1:], begin[:, -1:]], axis=1), begin)
            new = np.minimum(new, skip)
            run = np.minimum.accumulate(((new - offsets) << 8) | offsets, axis=1)              # document bytes without partner
            dist = np.minimum((run >> 8) + offsets, big)
            if places:
                begin = np.take_along_axis(src, run & 255, axis=1)
            elif r % 8 == 7:
                go = dist.min(1) <= e
                if not go.all():
                    alive, dist = alive[go], dist[go]
                    if not len(alive):
                        break
        if not places:
            return alive[dist.min(1) <= e] if len(alive) else alive, None, None
        j = dist.argmin(1)
        k = np.arange(len(row))
        return (np.maximum(origin + begin[k, j] - low, 0), np.minimum(origin + size + j, high) - low, dist[k, j].astype(np.int64))


def _blocks(benchmark: DataFrame) -> list[list]:
    """The items in blocks of bounded size (by hash of the id; one block for small benchmarks)."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).collect()[0].b or 0
    n = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _regions(docs: DataFrame, benchmark: DataFrame, keys: str) -> DataFrame:
    """The key columns of ``docs`` (all but the last; ``keys`` is their schema) and item_id, begin, end, segments, edits per region."""
    spark = docs.sparkSession
    C.ship(spark)
    names = docs.columns[:-1]
    found = []
    for rows in _blocks(benchmark):
        block = spark.sparkContext.broadcast(rows)

        def run(batches, block=block):
            items = Items(block.value)
            for b in batches:
                buf, off = C.utf8(b.column(len(names)))
                for lo, hi in C.slices(off):
                    piece, o = _FOLD[buf[off[lo]:off[hi]]], off[lo:hi + 1] - off[lo]
                    row, item, begin, end, edits = items.align(piece, o, *items.bands(piece, o))
                    if not len(row):
                        continue
                    order = np.lexsort((begin, item, row))
                    row, item, begin, end, edits = (x[order] for x in (row, item, begin, end, edits))
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
                    reach = end + np.cumsum(new) * (int(o[-1]) + 1)       # running end within the pair
                    new[1:] |= begin[1:] + np.cumsum(new)[1:] * (int(o[-1]) + 1) > np.maximum.accumulate(reach)[:-1]
                    s = np.flatnonzero(new)
                    at = pa.array(row[s] + lo)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(k).take(at) for k in range(len(names))] + [
                            pa.array([items.ids[i] for i in item[s]], pa.int64()),
                            pa.array(begin[s]), pa.array(np.maximum.reduceat(end, s)),
                            pa.array(np.diff(np.append(s, len(row)))), pa.array(np.minimum.reduceat(edits, s))],
                        names=[*names, "item_id", "begin", "end", "segments", "edits"])

        found.append(docs.mapInArrow(run, f"{keys}, item_id long, begin long, end long, segments long, edits long"))
    return reduce(DataFrame.unionByName, found)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, begin, end (bytes of the document), segments, edits (of the best segment): one row per region."""
    return _regions(docs.select("doc_id", "text"), benchmark, "doc_id long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark passage.

    A contaminated row is known by its id and a hash of its text: rows that share an id, or have none, are judged by their own texts.
    """
    bad_id, bad_text = C.fresh_name(docs, "bad_id"), C.fresh_name(docs, "bad_text")
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keyed = docs.select(docs["doc_id"].alias(bad_id), text_hash.alias(bad_text), docs["text"])
    found = _regions(keyed, benchmark, f"`{bad_id}` long, `{bad_text}` long").select(bad_id, bad_text).distinct()
    bad = small(C.store(found, "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[bad_id]) & (text_hash == bad[bad_text]), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contaminated regions of the documents: one row per document, benchmark item and stretch."""
    return matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
