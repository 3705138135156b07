"""Exact top-k search by inner product: columnar branch and bound.

Vectors are turned into integers (floor(256 x)) and stored in blocks in vertical
layout, one row per dimension. A query walks the dimensions block by block, the ones
with its largest components first, and adds up partial scores of all candidates at
once. What the remaining dimensions can still add is at most the product of the
remaining masses (norms) of query and candidate; candidates whose bound falls below
the k-th best score are dropped and the rest compacted.

Every block of queries meets every block of candidates once, as one row of a join on
the block number: work is spread over tasks, and a task holds two blocks. Each block
keeps k candidates per query, which the last step merges.

Defined results: vectors that are null, or hold a null or non-finite component, or
have no id, take no part, neither do empty vectors; vectors only meet vectors of
their own dimension; repeated equal rows count once; ties go to the smaller id; a
query never meets rows of its own id. Scores are exact while they fit 2**62.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washline.llm import common as C

SCALE, K = 256, 5
QUERY_BLOCK, CANDIDATE_BLOCK, DIMENSIONS = 512, 4096, 8


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long), dim of the vectors that take part, without repeated rows."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return (vectors.where(fine).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))
            .distinct().withColumn("dim", F.size("v")))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """dim, block, ids and vectors: rows dealt into blocks of about ``size`` by a hash of the row."""
    total = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"))
    n = F.greatest(F.lit(1), F.ceil(F.col("rows") / size)).cast("long")
    return (rows.join(F.broadcast(total), "dim").withColumn("of", n)
            .withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("of")))
            .groupBy("dim", "block", "of").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")))


def search(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray, order: np.ndarray, k: int):
    """(ids, scores) of the k best candidates for one query.

    ``columns`` (dimension, candidate); ``rest[j]``: squared mass of each candidate after j blocks of ``order``.
    """
    live = np.flatnonzero(ids != own)
    score = np.zeros(len(live), np.int64)
    left = np.add.reduceat((query[order].astype(float) ** 2), np.arange(0, len(order), DIMENSIONS))
    left = np.append(np.cumsum(left[::-1])[::-1], 0.0)
    for j in range(len(left) - 1):
        for d in order[j * DIMENSIONS:(j + 1) * DIMENSIONS]:
            if query[d]:
                score += query[d] * columns[d][live]
        if len(live) <= k:
            continue
        slack = np.sqrt(left[j + 1] * rest[j + 1][live]) * (1 + 1e-9) + 1
        floor = np.partition(score - slack, len(live) - k)[len(live) - k]
        keep = score + slack >= floor
        if keep.sum() < 0.9 * len(live):
            live, score = live[keep], score[keep]
    if len(live) > k:
        floor = np.partition(score, len(live) - k)[len(live) - k]
        keep = score >= floor
        live, score = live[keep], score[keep]
    best = np.lexsort((ids[live], -score))[:k]
    return ids[live][best], score[best]


def top_k(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the k best other rows."""
    spark = vectors.sparkSession
    C.ship(spark)
    rows = C.store(usable(vectors), "vectors")
    candidates = blocks(rows, CANDIDATE_BLOCK)
    queries = blocks(rows.where(F.pmod("vec_id", F.lit(every)) == 0), QUERY_BLOCK)
    counts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK)).cast("long").alias("n"))
    sent = (queries.join(F.broadcast(counts), "dim")
            .select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"), F.col("rows").alias("queries")))
    pairs = sent.join(candidates.select("dim", "block", "rows"), ["dim", "block"]).select("dim", "queries", "rows")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                dim = one.column(0)[0].as_py()
                q_ids, q = _rows(one.column(1), dim)
                ids, c = _rows(one.column(2), dim)
                columns = np.ascontiguousarray(c.T)
                out = []
                # queries share the order of dimensions of their block: the largest summed components first
                order = np.argsort(-np.abs(q).sum(0), kind="stable")
                mass = np.add.reduceat(columns[order].astype(float) ** 2, np.arange(0, dim, DIMENSIONS), axis=0)
                rest = np.concatenate([np.cumsum(mass[::-1], axis=0)[::-1], np.zeros((1, len(ids)))])
                for own, x in zip(q_ids, q):
                    found, score = search(x, own, ids, columns, rest, order, k)
                    tag = zlib.crc32(np.ascontiguousarray(x).tobytes())
                    out.append((np.full(len(found), own), np.full(len(found), tag), found, score))
                cols = [np.concatenate(x) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "tag", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, tag long, vec_id long, score long")
    place = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _rows(column, dim):
    """(ids, vectors) of the one list of structs in a column."""
    s = column.flatten()
    return s.field(0).to_numpy(zero_copy_only=False), s.field(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def op8_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best other rows of every row whose vec_id is divisible by 50."""
    return top_k(C.table(spark, sf_dir, "embeddings"))


ORACLE = {"op8_topk": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""}
