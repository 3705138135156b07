"""Conversation prefix trie: a splitter skeleton over range-partitioned, sorted conversations.

A conversation is a path: a 16-byte digest of (role, text) per turn. All conversations are
range partitioned by (path, conv_id) and sorted, so the members of a node (a prefix) lie side
by side, and a node reaches over the border of two shards only if the splitter at that border
begins with it. The trie of the splitters' paths, the *skeleton*, is broadcast:

* nodes outside the skeleton lie in one shard, which finishes them in one pass over its
  sorted rows (a stack of open nodes; subtree sums go to the parent when a node closes);
* a skeleton node gets a partial row from every shard that meets it; the partial rows are
  summed, and a bottom-up sweep over the skeleton adds its nodes to their parents.

Equal paths are split by conv_id, so a conversation that a third of all rows repeat is
spread over shards like any other. The splitters are quantiles of a sample by smallest hash
of at most ``SAMPLE`` rows a shard and ``SKELETON_TURNS`` turns in all: that bounds the
skeleton, and decides only where shards end. The ids that end at a node are hashed as they
come; for skeleton nodes shards write them in pieces of ``PIECE`` ids, which one pass in
order of the shards hashes without holding them (SHA-256 is a chain, one task must read it).

Defined results: turns sort by (turn, role, text) with null turns first, repeated rows are
repeated turns; null roles and texts are empty; rows with a null conv_id form one
conversation, whose id comes after all others, counts for no smallest member and is written
as the empty text; an empty table gives no rows; extra columns do not matter. A conversation
is one row (24 bytes a turn), so Spark's limit of 2 GB bounds it to some 80 million turns;
its texts are only held in blocks of ``BLOCK`` turn numbers (repeated or null turn numbers
stay together).
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm import common as C
from washline.llm.runs import CRC32

KEY = 16                    # bytes of a turn's digest
BLOCK = 256
SAMPLE = 20                 # sampled rows a shard
SKELETON_TURNS = 1 << 18    # turns in all sampled paths: bounds the skeleton
PIECE = 4096
_NONE = 1 << 63             # stands for the null id: larger than any


def conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> conv_id, path (digests one after another), sizes (UTF-8 bytes of the texts)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    blocks = (rows.groupBy("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")))
    key = lambda t: F.left(F.sha2(F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]).cast("binary"), 256),
                           F.lit(2 * KEY))
    blocks = blocks.select("conv_id", "block", F.array_join(F.transform("t", key), "").alias("path"),
                           F.transform("t", lambda t: F.octet_length(t["text"])).alias("sizes"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "path", "sizes"))).alias("b"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("b", lambda b: b["path"]), "")).alias("path"),
                        F.flatten(F.transform("b", lambda b: b["sizes"])).alias("sizes"))


def rebuild(convs: DataFrame) -> DataFrame:
    """The query's input: the first turns of a conversation come from the one at the next lower multiple of five.

    At most nine conversations share such a base (five, nine around id 0). The conversation without an id stays as it is.
    """
    c = F.col("c")
    base = F.col("conv_id") - F.col("conv_id") % 5
    groups = convs.groupBy(base.alias("base")).agg(F.collect_list(F.struct("conv_id", "path", "sizes")).alias("all"))
    first = F.get(F.filter("all", lambda x: x["conv_id"] == F.col("base")), F.lit(0))
    rows = groups.select(first.alias("o"), F.explode("all").alias("c"))
    h = F.when(c["conv_id"].isNull(), 0).otherwise((F.crc32(c["conv_id"].cast("string").cast("binary")) % 9).cast("int"))
    rows = rows.select(c["conv_id"].alias("conv_id"), "o", "c", h.alias("h"))
    own_path, own_sizes = F.substr(c["path"], F.col("h") * KEY + 1), F.slice(c["sizes"], F.col("h") + 1, F.greatest(F.size(c["sizes"]), F.lit(1)))
    return rows.select(
        "conv_id",
        F.when(F.col("o").isNull(), own_path).otherwise(F.concat(F.substr("o.path", F.lit(1), F.col("h") * KEY), own_path)).alias("path"),
        F.when(F.col("o").isNull(), own_sizes).otherwise(F.concat(F.slice("o.sizes", F.lit(1), F.col("h")), own_sizes)).alias("sizes"))


# ---------------------------------------------------------------- skeleton

class Skeleton:
    """Splitters (path, id) in order, and the trie of their paths; node 0 is the root."""

    def __init__(self, splitters):
        self.splitters = sorted(set(splitters))
        self.child: dict = {}       # (node, turn digest) -> node
        self.parent, self.depth = [-1], [0]
        for path, _ in self.splitters:
            at = 0
            for d in range(0, len(path), KEY):
                step = (at, path[d:d + KEY])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[step]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv_id))


def plant(convs: DataFrame, shards: int, sample: int = SAMPLE, most_turns: int = SKELETON_TURNS) -> Skeleton:
    """Splitters of about equal shards: quantiles of the rows with the smallest hashes."""
    rows = convs.select("path", "conv_id", F.xxhash64("conv_id", "path").alias("h"), (F.length("path") / KEY).cast("long").alias("turns"))
    rows = rows.where(F.col("turns") <= most_turns // 16)
    seen = rows.select("h", "turns").orderBy("h").limit(sample * shards).collect()
    total, cut = 0, None
    for r in seen:
        total += r.turns
        if total > most_turns:
            break
        cut = r.h
    if cut is None or shards < 2:
        return Skeleton([])
    picked = sorted((bytes(r.path), _NONE if r.conv_id is None else r.conv_id)
                    for r in rows.where(F.col("h") <= cut).select("path", "conv_id").collect())
    return Skeleton(picked[i * len(picked) // shards] for i in range(1, shards))


def _ids(batch, name: str) -> list[int]:
    return [_NONE if x is None else x for x in batch.column(name).to_pylist()]


def into_shards(convs: DataFrame, skeleton) -> DataFrame:
    """``convs`` with their shard number (``skeleton``: a broadcast ``Skeleton``)."""
    def run(batches):
        for b in batches:
            of = skeleton.value.shard
            shard = [of(p, c) for p, c in zip(b.column("path").to_pylist(), _ids(b, "conv_id"))]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *[b.column(c) for c in ("conv_id", "path", "sizes")]],
                                             names=["shard", "conv_id", "path", "sizes"])

    return convs.select("conv_id", "path", "sizes").mapInArrow(run, "shard int, conv_id long, path binary, sizes array<int>")


# ---------------------------------------------------------------- shards

_SCHEMA = ("kind int, skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, size long, ends string, shard int, piece long")
_NODE, _PART, _ENDS = 0, 1, 2


class _Open:
    """A node whose members are still coming in."""

    __slots__ = ("skeleton", "size", "least", "convs", "children", "leaves", "saved", "ends", "pieces", "waiting")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.size = skeleton, size       # -1: not in the skeleton
        self.least, self.convs, self.children, self.leaves, self.saved = _NONE, 0, 0, 0, 0
        self.ends = None            # a hash, or the ids of the next piece of a skeleton node
        self.pieces = 0
        self.waiting = []           # finished children, until this node's smallest member is known


class Shard:
    """One pass over the sorted conversations of one shard; finished rows gather in ``out``."""

    def __init__(self, number: int, skeleton: Skeleton, piece: int = PIECE):
        self.number, self.skeleton, self.piece = number, skeleton, piece
        self.out, self.path, self.stack = [], b"", [_Open(0, 0)]

    def add(self, path: bytes, conv_id: int, sizes: list) -> None:
        depth, same = len(path) // KEY, 0
        most = min(depth, len(self.path) // KEY)
        if path[:most * KEY] == self.path[:most * KEY]:
            same = most
        else:
            while path[same * KEY:(same + 1) * KEY] == self.path[same * KEY:(same + 1) * KEY]:
                same += 1
        while len(self.stack) > same + 1:
            self._close()
        for d in range(same, depth):
            above = self.stack[-1].skeleton
            here = self.skeleton.child.get((above, path[d * KEY:(d + 1) * KEY]), -1) if above >= 0 else -1
            self.stack.append(_Open(here, sizes[d]))
        self.path = path
        self._end(self.stack[-1], conv_id)

    def _end(self, node: _Open, conv_id: int) -> None:
        node.convs += 1
        node.least = min(node.least, conv_id)
        name = b"" if conv_id == _NONE else b"%d" % conv_id
        if node.skeleton < 0:
            if node.ends is None:
                node.ends = hashlib.sha256(name)
            else:
                node.ends.update(b"," + name)
            return
        node.ends = node.ends or []
        node.ends.append(name)
        if len(node.ends) >= self.piece:
            self._piece(node)

    def _piece(self, node: _Open) -> None:
        self._row(_ENDS, skeleton=node.skeleton, ends=b",".join(node.ends).decode(), piece=node.pieces)
        node.pieces += 1
        node.ends = None

    def _row(self, kind, skeleton=None, conv_id=None, depth=None, parent=None, node=None, ends=None, piece=None) -> None:
        n = node
        self.out.append((kind, skeleton, None if conv_id == _NONE else conv_id, depth, None if parent == _NONE else parent,
                         n and n.convs, n and n.children, n and n.leaves, n and n.saved, n and n.size, ends, self.number, piece))

    def _close(self) -> None:
        node = self.stack.pop()
        for child, depth, ends in node.waiting:
            self._row(_NODE, None, child.least, depth, node.least, child, ends)
        node.waiting = []
        if node.skeleton >= 0:
            if node.ends:
                self._piece(node)
            self._row(_PART, node.skeleton, node.least, len(self.stack), None, node)
            return
        if not node.children:
            node.leaves = 1
        node.saved += (node.convs - 1) * node.size
        ends = (node.ends or hashlib.sha256()).hexdigest()
        node.ends = None
        above = self.stack[-1]
        above.children += 1
        above.convs += node.convs
        above.least = min(above.least, node.least)
        above.leaves += node.leaves
        above.saved += node.saved
        if above.skeleton >= 0:
            self._row(_NODE, above.skeleton, node.least, len(self.stack), None, node, ends)
        else:
            above.waiting.append((node, len(self.stack), ends))

    def finish(self) -> None:
        while self.stack:
            self._close()

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        types = [pa.int32(), *[pa.int64()] * 9, pa.string(), pa.int32(), pa.int64()]
        cols = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[f.split()[0] for f in _SCHEMA.split(", ")])


def walk_shards(sharded: DataFrame, skeleton, shards: int, piece: int = PIECE) -> DataFrame:
    """Rows of finished nodes, of partial skeleton nodes and of ids that end at skeleton nodes."""
    def run(batches):
        shard = None
        for b in batches:
            for number, path, conv, sizes in zip(b.column("shard").to_pylist(), b.column("path").to_pylist(), _ids(b, "conv_id"),
                                                 b.column("sizes").to_pylist()):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.finish()
                        yield shard.take()
                    shard = Shard(number, skeleton.value, piece)
                shard.add(path, conv, sizes)
                if len(shard.out) >= 20_000:
                    yield shard.take()
        if shard is not None:
            shard.finish()
            yield shard.take()

    order = ["shard", "path", F.col("conv_id").asc_nulls_last()]
    return sharded.repartitionByRange(shards, "shard").sortWithinPartitions(*order).mapInArrow(run, _SCHEMA)


# ---------------------------------------------------------------- reduction

def _digests(ends: DataFrame, shards: int) -> DataFrame:
    """skeleton, ends_sha256: the pieces of a node hashed in order, one at a time."""
    def run(batches):
        node, h = None, None
        done = []
        for b in batches:
            for s, text in zip(b.column("skeleton").to_pylist(), b.column("ends").to_pylist()):
                if s != node:
                    if node is not None:
                        done.append((node, h.hexdigest()))
                    node, h = s, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if node is not None:
            done.append((node, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                         names=["skeleton", "ends_sha256"])

    return (ends.select("skeleton", "shard", "piece", "ends").repartition(shards, "skeleton").sortWithinPartitions("skeleton", "shard", "piece")
            .select("skeleton", "ends").mapInArrow(run, "skeleton long, ends_sha256 string"))


_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _sweep(parts: list, skeleton: Skeleton) -> pa.Table:
    """Skeleton nodes bottom up: each adds its finished sums to its parent. ``parts``: a summed row per node."""
    n = len(skeleton.parent)
    total = {c: [0] * n for c in _SUMS}
    least, size, met = [_NONE] * n, [0] * n, [False] * n
    for r in parts:
        met[r.skeleton], size[r.skeleton] = True, r.size
        least[r.skeleton] = _NONE if r.conv_id is None else r.conv_id
        for c in _SUMS:
            total[c][r.skeleton] = r[c]
    for u in range(n - 1, -1, -1):          # children have larger numbers than their parents
        if not met[u]:
            continue
        if not total["n_children"][u]:
            total["n_leaves"][u] = 1
        total["saved_tokens"][u] += (total["n_convs"][u] - 1) * size[u]
        p = skeleton.parent[u]
        if p >= 0:
            total["n_children"][p] += 1
            least[p] = min(least[p], least[u])
            for c in ("n_convs", "n_leaves", "saved_tokens"):
                total[c][p] += total[c][u]
    here = [u for u in range(n) if met[u]]
    known = lambda x: None if x == _NONE else x
    cols = {"skeleton": here, "conv_id": [known(least[u]) for u in here], "depth": [skeleton.depth[u] for u in here],
            "parent_conv_id": [known(least[skeleton.parent[u]]) if skeleton.parent[u] >= 0 else None for u in here],
            **{c: [total[c][u] for u in here] for c in _SUMS}}
    return pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()})


def prefix_trie(convs: DataFrame, shards: int | None = None, sample: int = SAMPLE, most_turns: int = SKELETON_TURNS,
                piece: int = PIECE) -> DataFrame:
    """One row per node of the trie of ``convs(conv_id, path, sizes)``; conv_id must be unique.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = convs.sparkSession
    C.ship(spark)
    shards = shards or C.partitions(spark)
    convs = C.store(convs, "trie-conversations")
    skeleton = plant(convs, shards, sample, most_turns)
    shared = spark.sparkContext.broadcast(skeleton)
    rows = C.store(walk_shards(into_shards(convs, shared), shared, shards, piece), "trie-nodes")
    parts = (rows.where(F.col("kind") == _PART).groupBy("skeleton")
             .agg(F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), *[F.sum(c).alias(c) for c in _SUMS]))
    swept = spark.createDataFrame(_sweep(parts.collect(), skeleton))
    digests = _digests(rows.where(F.col("kind") == _ENDS), shards)
    out = ["conv_id", "depth", "parent_conv_id", *_SUMS]
    tops = swept.join(digests, "skeleton", "left").select(*out, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    above = F.broadcast(swept.select("skeleton", F.col("conv_id").alias("above")))
    rest = rows.where(F.col("kind") == _NODE).join(above, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return rest.select(*out, F.col("ends").alias("ends_sha256")).unionByName(tops)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuild(conversations(C.table(spark, sf_dir, "conversations"))))


ORACLE = {"op12_prefix_trie": f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS s,
    list(sha256(strlen(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS k,
    list(strlen(text) ORDER BY turn NULLS FIRST, role, text) AS b FROM turns GROUP BY conv_id),
hashed AS (SELECT conv_id, s, k, b, CASE WHEN conv_id IS NULL THEN 0 ELSE {CRC32} % 9 END AS h FROM convs),
rebuilt AS (SELECT c.conv_id, c.s, coalesce(o.k[1:h], []) || c.k[h + 1:] AS k, coalesce(o.b[1:h], []) || c.b[h + 1:] AS b
    FROM hashed c LEFT JOIN convs o ON o.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, s, k, b, unnest(range(0, len(k) + 1)) AS depth FROM rebuilt),
nodes AS (SELECT md5(array_to_string(k[1:depth], '')) AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(k[1:depth]) AS path,
    coalesce(any_value(b[depth]), 0) AS bytes, md5(array_to_string(any_value(k[1:depth - 1]), '')) AS above,
    sha256(coalesce(string_agg(s, ',' ORDER BY conv_id NULLS LAST) FILTER (depth = len(k)), '')) AS ends_sha256
    FROM members GROUP BY node, depth),
kids AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
paths AS (SELECT path, unnest(range(0, depth + 1)) AS e, n_children IS NULL AS leaf, (n_convs - 1) * bytes AS saved FROM nodes LEFT JOIN kids USING (node)),
below AS (SELECT md5(array_to_string(path[1:e], '')) AS node, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
    FROM paths GROUP BY md5(array_to_string(path[1:e], '')))
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.above
"""}
