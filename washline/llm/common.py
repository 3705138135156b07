"""Helpers shared by the text operators: package shipping, shared storage, vectorised byte work.

The heavy loops run over whole Arrow batches as numpy arrays of UTF-8 bytes. A
batch is cut into slices of bounded size (``slices``), so the working memory of a
task follows the slice, not the partition; a single longer text is one slice.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict = {}


# ---------------------------------------------------------------- Spark side

def ship(spark: SparkSession) -> None:
    """Give the executors this package (once per application)."""
    import washline

    sc = spark.sparkContext
    if getattr(sc, "_washline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(washline.__file__))
    folder = tempfile.mkdtemp(prefix="washline-code-")
    target = os.path.join(folder, "washline_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("washline", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._washline_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder of ``spark.checkpoint.dir``.

    Where the setting is absent a private folder is made, for local masters only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _TABLES.setdefault("local_base", tempfile.mkdtemp(prefix="washline-shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and scan it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of its own per row in ``name``; smaller doc_ids have smaller numbers, null ids the largest.

    Where every doc_id is one row's and none is null, that is the doc_id; else the rows are
    ranged by (doc_id, text hash), numbered and written, so the numbers stay as they are.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).collect()
    if not odd:
        return docs.withColumn(name, F.col("doc_id"))
    place = fresh_name(docs, "_place")
    ranged = (docs.withColumn(place, F.monotonically_increasing_id())
              .orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), place).drop(place))
    return store(ranged.withColumn(name, F.monotonically_increasing_id()), "numbered")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def with_columns_schema(df: DataFrame, fields: list) -> tuple[list[str], object]:
    """Columns of ``df`` that survive next to new ``fields`` (a clashing old column is replaced), and the schema."""
    from pyspark.sql import types as T

    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    return [f.name for f in keep], T.StructType(keep + fields)


# ---------------------------------------------------------------- bytes of a batch

def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string()).cast(pa.large_binary())
    elif not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, budget: int = SLICE_BYTES):
    """Row ranges [lo, hi) of at most ``budget`` bytes each (at least one row)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: workers live on, and share the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):       # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (spreads every input bit over the word)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(30))
        h = h * U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(27)
        h *= U64(0x94D049BB133111EB)
        h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= n (kept per process, grown on demand)."""
    have = _TABLES.get("powers")
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            p = np.full(size, U64(_BASE))
            q = np.full(size, U64(pow(_BASE, -1, 1 << 64)))
            p[0] = q[0] = U64(1)
            have = _TABLES["powers"] = (np.cumprod(p, dtype=U64), np.cumprod(q, dtype=U64))
    return have


def byte_values() -> np.ndarray:
    """One fixed odd-looking 64-bit value per byte."""
    if "bytes" not in _TABLES:
        _TABLES["bytes"] = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    return _TABLES["bytes"]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums: the hash of any slice of ``buf`` is one difference away."""
    n = len(buf)
    out = np.zeros(n + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(byte_values()[buf] * powers(n)[0][:n], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hash of buf[start:end] for each span."""
    with np.errstate(over="ignore"):
        h = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses a text's end."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~SPACE[buf]
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    cut = offsets[1:-1]
    before[cut[cut < len(buf)]] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    after[cut[cut > 0] - 1] = False
    return np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1


def per_text(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the (sorted) starts lie in each text."""
    return np.diff(np.searchsorted(starts, offsets))


def shingles(word_hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-word shingle and its text's row. A text of 1 to n-1 words is one shingle as a whole."""
    rows = np.repeat(np.arange(len(counts)), counts)
    total = len(word_hashes)
    with np.errstate(over="ignore"):
        if total >= n:
            m = total - n + 1
            h = np.full(m, U64(n))
            for k in range(n):
                h = mix(h * U64(0x2545F4914F6CDD1D) + word_hashes[k:k + m])
            ok = rows[:m] == rows[n - 1:n - 1 + m]
            full, full_rows = h[ok], rows[:m][ok]
        else:
            full, full_rows = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < n))
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        left = counts[short]
        g = left.astype(U64)
        for k in range(n - 1):
            more = k < left
            at = np.minimum(first + k, max(total - 1, 0))
            g = np.where(more, mix(g * U64(0x2545F4914F6CDD1D) + (word_hashes[at] if total else g)), g)
    return np.concatenate([full, g]), np.concatenate([full_rows, short])
