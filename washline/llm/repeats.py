"""Repeated passages, by refinement of q-gram buckets (a distributed take on suffix sorting).

Every ``WIDTH``-byte string of the corpus that also starts earlier (smaller doc_id,
or same document and earlier start) marks its bytes. Suffixes are not sorted whole:

1. Initial buckets: of the Q-byte grams inside a window of WIDTH bytes the one with
   the smallest hash names the window's bucket, so equal windows share a bucket, and
   neighbouring windows mostly share one gram: a run. Only runs travel (about one
   per 39 bytes).
2. Refinement: a bucket is sorted by the identifier of the whole stretch a run
   covers, then by (doc_id, start). Runs whose identifier occurred before are marked
   at once, over their whole stretch; the verdict of one sort settles all its windows.
3. Recursion: only buckets that still hold different stretches (the rims of
   repeats) are refined further. Their runs are cut, at fixed distances from the gram,
   into blocks of up to ``BLOCK`` windows. The bytes that a block's windows have in
   common name its next bucket; the few bytes around them tell the windows apart, so
   this sort settles every single window.

Copies inside one Arrow batch are settled before the shuffle, so a hot group sends
one row per batch. Identifiers are 64-bit content hashes within a 64-bit bucket.

A row is known by its doc_id; where ids repeat or are null, by doc_id and a 64-bit hash
of its text (equal rows lose the same bytes, so they need not be told apart).

Defined results: null text is empty; texts under WIDTH bytes lose nothing; rows
with one doc_id are one document at equal starts (neither is earlier), and rows
with a null doc_id come after all others (as one document, which the largest possible
id belongs to); extra columns are kept by ``remove_repeats``, one named ``n_removed`` is
replaced. A text is worked on in one piece, at about 60 times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.llm import common as C

WIDTH, Q, BLOCK = 100, 24, 8
LAST = (1 << 63) - 1
_POS_BITS = 31              # a text has less than 2 GB


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``: 0 where every id is one row's, else a hash of the text."""
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).collect()
    return docs.withColumn("_row", F.xxhash64(F.coalesce("text", F.lit(""))) if odd else F.lit(0).cast("long"))


def runs(buf: np.ndarray, off: np.ndarray, sums: np.ndarray, width: int, q: int):
    """(bucket, identifier, text row, start, gram's distance from it, windows) of every run of windows of the texts."""
    n, grams = len(buf), width - q + 1
    empty = (np.zeros(0, C.U64), np.zeros(0, C.U64), *(np.zeros(0, np.int64) for _ in range(4)))
    long_enough = np.flatnonzero(np.diff(off) >= width)
    if not len(long_enough):
        return empty
    at = np.arange(n - q + 1)
    gram = C.span_hashes(sums, at, at + q)
    low = (gram >> C.U64(_POS_BITS) << C.U64(_POS_BITS)) | at.astype(C.U64)
    size = -(-len(low) // grams) * grams
    pad = np.full(size, ~C.U64(0))
    pad[:len(low)] = low
    blocks = pad.reshape(-1, grams)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    anchor = (np.minimum(right[:m], left[grams - 1:grams - 1 + m]) & C.U64((1 << _POS_BITS) - 1)).astype(np.int64)
    edge = np.zeros(m + 1, np.int8)
    np.add.at(edge, off[long_enough], 1)
    np.add.at(edge, off[long_enough + 1] - width + 1, -1)
    valid = np.cumsum(edge[:m], dtype=np.int8) > 0
    start = valid.copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(start)
    stop = np.cumsum(valid)
    count = np.diff(np.append(stop[starts] - 1, stop[-1]))
    rows = np.searchsorted(off, starts, "right") - 1
    return (gram[anchor[starts]], C.span_hashes(sums, starts, starts + count - 1 + width), rows, starts - off[rows],
            anchor[starts] - starts, count)


def _pack(start, gram, count):
    """start, distance to the gram, windows in one number that sorts by start."""
    return (start << 14) | (gram << 7) | count


def _settle(bucket, ident, doc, pack):
    """Sort by (bucket, identifier, doc, start); (order, is a later copy) of the rows."""
    order = np.lexsort((pack, doc, ident, bucket))
    b, i, d, s = bucket[order], ident[order], doc[order], pack[order] >> 14
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (i[1:] != i[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    return order, (d != d[head]) | (s != s[head])


def _doc_ids(col) -> np.ndarray:
    return col.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


_RUN_SCHEMA = "bucket long, ident long, doc long, row long, pack long, settled boolean"


def _run_batch(bucket, ident, doc, row, pack):
    order, later = _settle(bucket, ident, doc, pack)
    return pa.RecordBatch.from_arrays(
        [pa.array(x[order].view(np.int64)) for x in (bucket, ident, doc, row, pack)] + [pa.array(later)],
        names=["bucket", "ident", "doc", "row", "pack", "settled"])


def _emit_runs(batches, width, q):
    for b in batches:
        buf, off = C.utf8(b.column(1))
        ids, key, parts = _doc_ids(b.column(0)), _doc_ids(b.column(2)), []
        for lo, hi in C.slices(off):
            o = off[lo:hi + 1] - off[lo]
            sums = C.prefix_sums(buf[off[lo]:off[hi]])
            bucket, ident, rows, start, gram, count = runs(buf[off[lo]:off[hi]], o, sums, width, q)
            parts.append((bucket, ident, ids[lo:hi][rows], key[lo:hi][rows], _pack(start, gram, count)))
        if parts:
            yield _run_batch(*(np.concatenate(x) for x in zip(*parts)))


def _by_bucket(batches, work):
    """Feed ``work`` whole buckets of rows sorted by their first column, a batch at a time."""
    left = None
    for b in batches:
        rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        if left is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(left, rows)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        left = [x[cut:] for x in rows]
        if cut:
            yield work(*[x[:cut] for x in rows])
    if left is not None and len(left[0]):
        yield work(*left)


_MARK_SCHEMA = "doc long, row long, pack long, open boolean"


def _refine(bucket, ident, doc, row, pack, settled):
    """One bucket pass: copies become marks, first runs of buckets with several stretches stay open."""
    order, later = _settle(bucket, ident, doc, pack)
    b, i = bucket[order], ident[order]
    later |= settled[order]
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    kinds = np.ones(len(b), bool)
    kinds[1:] = first[1:] | (i[1:] != i[:-1])
    group = np.cumsum(first) - 1
    several = np.bincount(group[kinds], minlength=group[-1] + 1)[group] > 1
    keep = later | several
    return pa.RecordBatch.from_arrays([pa.array(x[order][keep]) for x in (doc, row, pack)] + [pa.array(~later[keep])],
                                      names=["doc", "row", "pack", "open"])


_BLOCK_SCHEMA = "bucket long, left long, right long, doc long, row long, pack long, settled boolean"


def _words_at(buf, at, n):
    """The ``n`` (under 8) bytes from each position, as one number, first byte lowest; 0 beyond the buffer's ends."""
    out = np.zeros(len(at), np.int64)
    for k in range(n):
        p = at + k
        out |= np.where((p >= 0) & (p < len(buf)), buf[np.clip(p, 0, len(buf) - 1)], 0).astype(np.int64) << (8 * k)
    return out


def _emit_blocks(batches, width):
    """Blocks of the open runs: common bytes (bucket), the bytes left and right of them, windows present (in pack)."""
    edge = BLOCK - 1
    for b in batches:
        buf, off = C.utf8(b.column(1))
        ids, key, parts = _doc_ids(b.column(0)), _doc_ids(b.column(2)), []
        lists = b.column(3)
        flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        for lo, hi in C.slices(off):
            piece, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            sums = C.prefix_sums(piece)
            packs = flat[cuts[lo]:cuts[hi]]
            rows = np.repeat(np.arange(hi - lo), np.diff(cuts[lo:hi + 1]))
            # distances from window to gram run from far to near; blocks are multiples of BLOCK
            far = (packs >> 7) & 0x7F
            near = far - (packs & 0x7F) + 1
            first, many = near // BLOCK, far // BLOCK - near // BLOCK + 1
            k = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            packs, rows, far, near = (np.repeat(x, many) for x in (packs, rows, far, near))
            core = (packs >> 14) + far - k * BLOCK                  # the block's last window starts here, in its text
            present = np.zeros(len(k), np.int64)
            for i in range(BLOCK):                                  # window i starts at core - edge + i
                distance = k * BLOCK + edge - i
                present |= ((distance <= far) & (distance >= near)).astype(np.int64) << i
            at = o[rows] + core
            parts.append((C.span_hashes(sums, at, at + width - edge), _words_at(piece, at - edge, edge),
                          _words_at(piece, at + width - edge, edge), ids[lo:hi][rows], key[lo:hi][rows], (core << 8) | present))
        if parts:
            bucket, left, right, doc, row, pack = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64)), *map(pa.array, (left, right, doc, row, pack)), pa.array(np.zeros(len(pack), bool))],
                names=["bucket", "left", "right", "doc", "row", "pack", "settled"])


def _settle_windows(bucket, left, right, doc, row, pack, settled):
    """Later copies among the single windows of blocks with common bytes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    alone = np.ones(len(b), bool)
    alone[1:] = b[1:] != b[:-1]
    alone[:-1] &= alone[1:]
    bucket, left, right, doc, row, pack = (x[order[~alone]] for x in (bucket, left, right, doc, row, pack))
    found = []
    for i in range(BLOCK):
        have = (pack >> i) & 1 == 1
        # window i takes the last BLOCK-1-i bytes on the left and the first i on the right
        rim = C.mix((left[have] >> (8 * i)).view(C.U64)) ^ (right[have] & ((1 << (8 * i)) - 1)).view(C.U64)
        start = (pack[have] >> 8) - (BLOCK - 1) + i
        own = _pack(start, 0, 1)
        o, later = _settle(bucket[have].view(C.U64), C.mix(rim), doc[have], own)
        found.append((doc[have][o][later], row[have][o][later], own[o][later]))
    cols = [np.concatenate(x) for x in zip(*found)]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.zeros(len(cols[0]), bool))], names=["doc", "row", "pack", "open"])


def marks(docs: DataFrame, width: int = WIDTH, q: int = Q) -> DataFrame:
    """doc, row, pack (start, windows) of ``docs(doc_id, text, _row)``: stretches that only hold later copies."""
    spark = docs.sparkSession
    C.ship(spark)
    docs = docs.select("doc_id", "text", "_row")

    def by_bucket(df):
        # settled copies may go anywhere; only the open rows of a bucket must meet
        to = F.when(F.col("settled"), F.xxhash64("doc", "row", "pack")).otherwise(F.col("bucket"))
        return df.repartition(C.partitions(spark), to).sortWithinPartitions("bucket")

    emitted = docs.mapInArrow(lambda it: _emit_runs(it, width, q), _RUN_SCHEMA)
    first = C.store(by_bucket(emitted).mapInArrow(lambda it: _by_bucket(it, _refine), _MARK_SCHEMA), "marks")
    texts = _joined(docs, first.where("open")).where("packs is not null").select("doc_id", "text", "_row", "packs")
    blocks = texts.mapInArrow(lambda it: _emit_blocks(it, width), _BLOCK_SCHEMA)
    second = by_bucket(blocks).mapInArrow(lambda it: _by_bucket(it, _settle_windows), _MARK_SCHEMA)
    return first.where("not open").select("doc", "row", "pack").unionByName(second.select("doc", "row", "pack"))


def _joined(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` with the packs of their rows (null: none); ``packs`` must not be a column of ``docs``."""
    m = marked.groupBy(F.col("doc").alias("_mark_doc"), F.col("row").alias("_mark_row")).agg(F.collect_list("pack").alias("packs"))
    return docs.join(m, (F.coalesce(docs["doc_id"], F.lit(LAST)) == m["_mark_doc"]) & (docs["_row"] == m["_mark_row"]), "left")


def spans(packs: np.ndarray, width: int) -> np.ndarray:
    """Maximal marked byte ranges (k, 2) of one text."""
    if not len(packs):
        return np.zeros((0, 2), np.int64)
    lo = packs >> 14
    hi = lo + (packs & 0x7F) - 1 + width
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return np.stack([lo[first], hi[np.append(first[1:], len(lo)) - 1]], axis=1)


def _each_text(b, text_at, packs_at, width):
    """(bytes, marked ranges) of every row of a batch."""
    buf, off = C.utf8(b.column(text_at))
    lists = b.column(packs_at)
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for lo, hi in C.slices(off):
        for i in range(lo, hi):
            yield buf[off[i]:off[i + 1]], spans(flat[cuts[i]:cuts[i + 1]], width)


def removal_digest(docs: DataFrame, width: int = WIDTH, q: int = Q) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    def run(batches):
        for b in batches:
            n, gone, k, sha = [], [], [], []
            for raw, cut in _each_text(b, 1, 2, width):
                digest, at = hashlib.sha256(), 0
                for lo, hi in cut.tolist():
                    digest.update(raw[at:lo])
                    at = hi
                digest.update(raw[at:])
                n.append(len(raw))
                gone.append(int((cut[:, 1] - cut[:, 0]).sum()))
                k.append(len(cut))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = _keyed(docs.select("doc_id", "text"))
    return _joined(keyed, marks(keyed, width, q)).select("doc_id", "text", "packs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(raw: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Shrink each range to whole UTF-8 characters."""
    out = []
    for lo, hi in cut.tolist():
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return np.array(out, np.int64).reshape(-1, 2)


def remove_repeats(docs: DataFrame, width: int = WIDTH, q: int = Q) -> DataFrame:
    """``docs`` with later copies cut out of ``text`` (whole characters) and ``n_removed`` bytes."""
    cols = [f for f in docs.schema.fields if f.name.lower() != "n_removed"]
    names = [f.name for f in cols]
    schema = T.StructType([*cols, T.StructField("n_removed", T.LongType())])
    # other columns travel under names of their own: they may clash with the join's
    own = {n: n if n in ("doc_id", "text") else f"_own_{i}" for i, n in enumerate(names)}
    keyed = _keyed(docs.select(*[F.col(f"`{n}`").alias(own[n]) for n in names]))
    joined = _joined(keyed, marks(keyed, width, q)).select(*own.values(), "packs")
    text_at = names.index("text")

    def run(batches):
        for b in batches:
            texts, gone = [], []
            for raw, cut in _each_text(b, text_at, len(names), width):
                cut = _whole_characters(raw, cut)
                at, kept = 0, []
                for lo, hi in cut.tolist():
                    kept.append(raw[at:lo].tobytes())
                    at = hi
                texts.append(b"".join([*kept, raw[at:].tobytes()]).decode("utf-8", "replace"))
                gone.append(int((cut[:, 1] - cut[:, 0]).sum()))
            new = pa.array(texts, pa.string())
            if b.column(text_at).null_count:
                new = pa.compute.if_else(b.column(text_at).is_null(), pa.scalar(None, pa.string()), new)
            yield pa.RecordBatch.from_arrays([new if i == text_at else b.column(i) for i in range(len(names))]
                                             + [pa.array(gone, pa.int64())], names=[*names, "n_removed"])

    return joined.mapInArrow(run, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return removal_digest(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
