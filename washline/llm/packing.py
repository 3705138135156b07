"""Harmonic packing of documents into training sequences.

A document is its token ids followed by an end id. Lengths are cut to reciprocal
capacities: whole sequences, then pieces of a half, a quarter, ... down to
``capacity / 2**halvings``, each size a class whose bins take a fixed number of
pieces (2, 4, 8, ...) and are exactly full. What remains of a document, shorter than
the smallest such piece, goes whole into the harmonic class ``capacity // length``,
whose bins take that many pieces. Every task fills its own bins, so nothing is
shuffled. When a task ends, the open bins of the halved classes become sequences of
a power of two, and the leftover small pieces are chained, cut freely, into full
sequences and powers of two; so padding only arises in bins of small pieces.

Token ids are those of the tokenizer on the whole text. As its rules never join
across white space, or between a letter or digit and most ASCII signs, the text is
cut there and equal cuts are encoded once (a bounded cache per worker).

Defined results: null and empty texts are the end id alone; repeated rows are packed
one by one; an empty table gives no rows; extra columns do not matter. Sequence ids
come from the partition number and a counter, so a task that runs again gives the
same ones.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from washline.llm import common as C

CAPACITY, HALVINGS, END_ID = 2048, 5, 1
CACHE_PIECES = 1_000_000

_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 13, 32]] = True
_SIGN = np.zeros(256, bool)         # ASCII signs except ' (contractions) and < | > (control tokens)
_SIGN[[ord(c) for c in ".,;:!?()\"#$%&*-+=/[]{}_~`@^\\"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(97, 123), *range(65, 91), *range(48, 58)]] = True


class CachedTokenizer:
    """Token ids of many texts; equal pieces are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self):
        self.keys = np.zeros(0, C.U64)
        self.first = self.count = np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        n = len(buf)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        # control tokens are matched before lower-casing, so case stays where one may occur
        low = buf if b"<|" in buf.tobytes() else C.lower_ascii(buf)
        ink = ~_BREAK[low]
        start = ink.copy()
        prev_ink = np.concatenate([[False], ink[:-1]])
        sign, alnum = _SIGN[low], _ALNUM[low]
        letter = alnum.copy()        # also the letters of U+00C0..U+00FF
        letter[1:] |= (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7) & (low[1:] >= 0x80)
        turn = np.zeros(n, bool)
        turn[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & alnum[1:])
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        start &= ~prev_ink | turn | edge[:n]
        starts = np.flatnonzero(start)
        stop = np.concatenate([ink[1:], [False]])
        stop = ink & (~stop | np.concatenate([start[1:], [True]]))
        ends = np.flatnonzero(stop) + 1
        pieces = C.per_text(off, starts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        keys, first, back = np.unique(C.span_hashes(C.prefix_sums(low), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_PIECES:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw, f = low.tobytes(), first[new]
            got = [e.ids for e in self.tokenizer.encode_batch(
                [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[f].tolist(), ends[f].tolist())], add_special_tokens=False)]
            count = np.array([len(g) for g in got], np.int64)
            flat = np.array([i for g in got for i in g], np.uint32)
            while self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(len(self.store), np.uint32)])
            self.store[self.used:self.used + len(flat)] = flat
            place = self.used + np.cumsum(count) - count
            self.used += len(flat)
            slot = np.searchsorted(self.keys, keys[new])
            self.keys, self.first, self.count = (np.insert(x, slot, y) for x, y in (
                (self.keys, keys[new]), (self.first, place), (self.count, count)))
            at = np.searchsorted(self.keys, keys)
        count = self.count[at][back]
        ends_at = np.cumsum(count)
        total = int(ends_at[-1])
        ids = self.store[np.repeat(self.first[at][back] - (ends_at - count), count) + np.arange(total)]
        cuts = np.concatenate([[0], np.cumsum(pieces)])
        sums = np.concatenate([[0], ends_at])
        return ids, sums[cuts[1:]] - sums[cuts[:-1]]


_TOKENIZERS: dict = {}


def tokenizer(path: str) -> CachedTokenizer:
    """The worker's tokenizer for ``path``: its cache outlives a task."""
    from washline.llm import packing as home

    if path not in home._TOKENIZERS:
        home._TOKENIZERS[path] = home.CachedTokenizer(path)
    return home._TOKENIZERS[path]


class Bins:
    """Open bins of one task. A piece is (document row, start, ids); emitted pieces carry sequence and offset."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, halvings: int = HALVINGS):
        self.capacity, self.smallest = capacity, capacity >> halvings
        self.next, self.open, self.out = first_sequence, {}, []

    def _emit(self, pieces):
        at = 0
        for doc, start, ids in pieces:
            self.out.append((doc, start, ids, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray):
        start, n = 0, len(ids)
        while n - start >= self.smallest:
            size = min(self.capacity, 1 << ((n - start).bit_length() - 1))
            self._put(size, self.capacity // size, (doc, start, ids[start:start + size]))
            start += size
        if start < n:
            per_bin = self.capacity // (n - start)
            self._put(-per_bin, per_bin, (doc, start, ids[start:]))

    def _put(self, kind, per_bin, piece):
        bin_ = self.open.setdefault(kind, [])
        bin_.append(piece)
        if len(bin_) == per_bin:
            self._emit(self.open.pop(kind))

    def close(self):
        rest = []
        for kind in sorted(self.open, reverse=True):
            pieces = self.open[kind]
            if kind < 0:
                rest += pieces
                continue
            while pieces:       # as many as a power of two: the sequence's length is one, too
                k = 1 << (len(pieces).bit_length() - 1)
                self._emit(pieces[:k])
                pieces = pieces[k:]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            took = []
            while room:
                doc, start, ids = rest.pop(0)
                took.append((doc, start, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:]))
                room -= len(took[-1][2])
            self._emit(took)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, halvings: int = HALVINGS,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids."""
    C.ship(docs.sparkSession)
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids array<int>" * with_ids)

    def rows(bins: Bins):
        out, bins.out = bins.out, []
        cols = [pa.array([o[0][0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([len(o[2]) for o in out], pa.int64()), pa.array([zlib.crc32(o[2].tobytes()) for o in out], pa.int64()),
                pa.array([o[0][1] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.int64()),
                pa.array([o[4] for o in out], pa.int64())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            sizes = np.cumsum([0, *(len(o[2]) for o in out)]).astype(np.int32)
            flat = np.concatenate([o[2] for o in out]) if out else np.zeros(0, np.uint32)
            cols.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        own = tokenizer(vocabulary)
        bins = Bins(TaskContext.get().partitionId() << 40, capacity, halvings)
        for b in batches:
            buf, off = C.utf8(b.column(1))
            names = b.column(0).to_pylist()
            for lo, hi in C.slices(off):
                ids, counts = own.encode(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                at = 0
                for name, n in zip(names[lo:hi], counts.tolist()):
                    whole = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    bins.add((name, n + 1), whole)
                    at += n
                if len(bins.out) > 20_000:
                    yield rows(bins)
        bins.close()
        yield rows(bins)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return pack(C.table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
