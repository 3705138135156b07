"""Periodic run detection: a sparse diagonal DP over the words of a text.

A run is a longest stretch of consecutive words with smallest period q (words q apart are
identical) that holds at least ``MIN_WORDS`` words and ``MIN_POWER`` periods. On the
diagonal of lag q the stretch shows as a match length of (stretch - q), which grows by one
with every word whose earlier occurrence lies q words back, and ends where none does.

Text with frequent words has far too many pairs of equal words to follow them all, so the
DP is sparse: a word looks back with a context of k words, and only the *nearest* earlier
occurrence of that context counts; its lag is the word's active diagonal at scale k. The
scales are k = 5, 10, 20 ..., and scale k answers for the periods in (k/2, k] (the first
for 1 to 5). Nothing is lost by that:

* a sufficient diagonal has a match length of at least max(6 - q, 3q), which is 5 or more and
  at least k on its own scale, so the context fits into it;
* inside a run of period q <= k, k words occur again first q words back: an occurrence
  between would give the stretch a smaller period;
* so the words of the run whose context has an earlier occurrence in it are exactly one
  unbroken stretch of the active lag q, and its ends give the run's ends.

A word that continues its diagonal adds one to that lag's match length; where the lag
changes the diagonal ends, and if it is long enough its run is emitted. Contexts are
numbered exactly (no hashes): a number per word, then numbers of pairs of numbers, twice as
long each time, kept only for contexts that occur again in their text. Work is n log n for
any text; a slice of a batch is handled at once with numpy.

Defined results: null and empty texts have no words, no runs and collapse to the empty
text; rows are judged one by one (null ids, repeated ids and rows); an empty table gives no
rows; columns of ``docs`` named ``runs`` or ``collapsed`` are replaced. A single text is
worked on in one piece (about 200 bytes of working memory a word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washline.llm import common as C

MIN_WORDS, MIN_POWER = 6, 4
FIRST_SCALE = 5
_RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
_RUN_ARROW = pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")])


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word; equal words, equal numbers."""
    if not len(starts):
        return np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    ink = buf[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(ink)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number per pair; equal pairs, equal numbers."""
    width = int(b.max()) + 1 if len(b) else 1
    if len(a) and (int(a.max()) + 1) * width >= 1 << 62:
        a = np.unique(a, return_inverse=True)[1]
    return a * width + b


def _group(keys: np.ndarray, places: np.ndarray, text: np.ndarray):
    """(numbers, lags, again): per place a number of its key, the distance to the key's nearest
    earlier place in the same text (0: none), and whether the key has another place in the text."""
    order = np.argsort(keys, kind="stable")
    k, p = keys[order], places[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    numbers = np.empty(len(k), np.int64)
    numbers[order] = np.cumsum(new) - 1
    lag = np.zeros(len(k), np.int64)
    if len(k):
        near = ~new[1:] & (text[p[1:]] == text[p[:-1]])
        lag[1:] = np.where(near, p[1:] - p[:-1], 0)
    again = lag > 0
    again[:-1] |= lag[1:] > 0
    out, keep = np.empty(len(k), np.int64), np.empty(len(k), bool)
    out[order], keep[order] = lag, again
    return numbers, out, keep


def _ended(places: np.ndarray, lags: np.ndarray, text: np.ndarray, k: int, at_least: int, found: list) -> None:
    """Diagonals of scale ``k``: unbroken stretches of one lag; sufficient ones are emitted."""
    on = (lags >= at_least) & (lags <= k)
    p, d = places[on], lags[on]
    if not len(p):
        return
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (text[p[1:]] != text[p[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    lag = d[first]
    match = last - first + k            # the first place matches with its whole context
    enough = match >= np.maximum(MIN_WORDS - lag, (MIN_POWER - 1) * lag)
    found.append((p[first][enough] - k + 1 - lag[enough], match[enough] + lag[enough], lag[enough]))


def runs_of(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts whose word numbers lie one after another (``counts`` per text).

    Returns starts (places among all words), lengths and periods, by start, then period.
    """
    total = len(words)
    text = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    longest = int(counts.max()) if len(counts) else 0
    found: list = []
    k = FIRST_SCALE
    places = np.flatnonzero(within >= k - 1)
    if longest >= MIN_WORDS and len(places):
        three = _pairs(_pairs(words[:-2], words[1:-1]), words[2:])           # starts at its first word
        three = _group(three, np.arange(total - 2), text)[0]
        keys = _pairs(_pairs(three[places - 4], words[places - 1]), words[places])
        numbers, lags, again = _group(keys, places, text)
        _ended(places, lags, text, k, 1, found)
        while 2 * k <= longest:
            dense = np.full(total, -1, np.int64)
            dense[places[again]] = numbers[again]
            places = np.flatnonzero(dense >= 0)
            places = places[within[places] >= 2 * k - 1]
            places = places[dense[places - k] >= 0]
            if not len(places):
                break
            numbers, lags, again = _group(_pairs(dense[places - k], dense[places]), places, text)
            k *= 2
            _ended(places, lags, text, k, k // 2 + 1, found)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort([period, start])
    return start[order], length[order], period[order]


def collapse(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, runs) -> pa.Array:
    """The texts without the words after the first period of any run, joined by one space."""
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, runs[0] + runs[2], 1)
    np.add.at(edge, runs[0] + runs[1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    text = np.repeat(np.arange(len(counts)), counts)[kept]
    inner = np.zeros(len(kept), bool)           # not the first kept word of its text: the byte before it becomes a space
    inner[1:] = text[1:] == text[:-1]
    mark = np.zeros(len(buf) + 1, np.int64)
    mark[starts[kept] - inner] += 1
    np.add.at(mark, ends[kept], -1)
    keep = np.cumsum(mark[:-1]) > 0
    out = buf.copy()
    out[starts[kept][inner] - 1] = 32
    size = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with ``runs`` (array of start, length, period in words) and the ``collapsed`` text."""
    C.ship(docs.sparkSession)
    new = [T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())]
    keep, schema = C.with_columns_schema(docs, new)
    at = keep.index("text")

    def slice_of(b, buf, off, lo, hi):
        part, cut = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        starts, ends = C.words(part, cut)
        counts = C.per_text(cut, starts)
        found = runs_of(word_numbers(part, starts, ends), counts)
        first = np.cumsum(counts) - counts
        owner = np.searchsorted(first + counts, found[0], "right")
        sizes = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(found[0] - first[owner]), pa.array(found[1]), pa.array(found[2])], fields=list(_RUN_ARROW))
        runs = pa.ListArray.from_arrays(pa.array(sizes), values)
        text = collapse(part, cut, starts, ends, counts, found)
        return pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in range(len(keep))] + [runs, text],
                                          names=[*keep, "runs", "collapsed"])

    def run(batches):
        for b in batches:
            buf, off = C.utf8(b.column(at))
            for lo, hi in C.slices(off):
                yield slice_of(b, buf, off, lo, hi)

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def rebuild(docs: DataFrame) -> DataFrame:
    """The query's input: in about every tenth document the words repeat from a place on (a null id counts as the empty text)."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")

    def periodic(w):
        n = F.size(w)
        a = F.when(n > 0, (g % F.greatest(n, F.lit(1))).cast("int")).otherwise(0)
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        turned = F.transform(w, lambda x, i: F.when(i >= a, F.get(w, a + (i - a) % p)).otherwise(x))
        return F.array_join(turned, " ")

    again = F.element_at(F.transform(F.array(words), periodic), 1)
    return docs.select("doc_id", F.when(h % 10 == 0, again).otherwise(F.col("text")).alias("text"))


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs and the collapsed text of every (rebuilt) document, as digests."""
    found = periodic_runs(rebuild(C.table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    digest = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                          _sha(F.array_join(line, "")).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.q")
    return digest.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
                         F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: crc32 of the decimal text in column ``s`` (a step per bit; -1 marks a shift)
CRC32 = """xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(s) + 1),
    lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""

ORACLE = {"op11_periodic_runs": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, {CRC32} AS h FROM docs),
placed AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM hashed),
turned AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM placed),
words AS (SELECT r, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word
    FROM (SELECT *, unnest(range(0, n)) AS i FROM turned)),
matches AS (SELECT y.r, y.i - x.i AS d, y.i AS j FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
diagonals AS (SELECT r, d, min(j) AS j0, count(*) AS l FROM (SELECT *, j - row_number() OVER (PARTITION BY r, d ORDER BY j) AS g FROM matches)
    GROUP BY r, d, g HAVING count(*) >= greatest(6 - d, 3 * d)),
runs AS (SELECT r, j0 - d AS start, l + d AS length, min(d) AS period FROM diagonals GROUP BY r, j0 - d, l + d),
per_doc AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min({{'start': start, 'length': length, 'period': period}}, [-length, start, period]) AS b FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM docs LEFT JOIN per_doc USING (r) LEFT JOIN kept USING (r)
"""}
