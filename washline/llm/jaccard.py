"""N-gram Jaccard join: count-vector R-tree over hashed shingle groups, exact verification.

Lower-cased (A-Z) words give each text the set of its n-word shingles, as 64-bit
hashes. Texts with equal sets form one class; only classes are joined.

1. Every class emits the shingles of its prefix (any partner at the threshold shares
   one of them). Shingles are ordered rare-first by a bounded table of frequent hash
   buckets; the order steers cost only, the result is the same for any order.
2. Classes that share a prefix shingle form a group, cut where sizes jump too far for
   a link. Each group first proposes links to one centre, the member that meets the
   most others; these are verified on the whole sets and give first components, so a
   large group of near copies costs about one verification per member, not per pair.
3. Groups that still span several components go through the R-tree: shingles are
   hashed into groups, a class is the point of its group counts, and the overlap of
   two boxes is at most the sum of their coordinate minima. Packed nodes are joined
   top-down; pairs of different components that survive are bounded once more by
   their finest common point (a class has about ``LOAD`` shingles per group, and
   folding halves gives the coarser points) and then verified.

Defined results: null, empty and wordless texts have the empty set, link with
nothing and are their own component; repeated rows fall into one class; ids may be
null (a component's id is its smallest non-null id); columns other than ``doc_id``
and ``text`` do not matter. Two different shingles share a hash with odds of 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline.llm import common as C
from washline.llm.components import components

COARSE, LOAD = 5, 4          # the tree's points have 2**COARSE coordinates
GROUPS = 1 << COARSE
FREQUENT_BITS, FREQUENT_TABLE = 22, 65_536
LEAF, FAN, DIRECT, SHARED = 32, 16, 16, 64
BROADCAST_ROWS = 2_000_000


def _sets(buf: np.ndarray, offsets: np.ndarray, n: int):
    """(sorted distinct shingle hashes, text row of each) of the texts."""
    low = C.lower_ascii(buf)
    starts, ends = C.words(low, offsets)
    h, rows = C.shingles(C.span_hashes(C.prefix_sums(low), starts, ends), C.per_text(offsets, starts), n)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[first], rows[first]


def _class_ids(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One 64-bit id per shingle set."""
    with np.errstate(over="ignore"):
        def total(x):
            s = np.concatenate([np.zeros(1, C.U64), np.cumsum(x, dtype=C.U64)])
            return s[cuts[1:]] - s[cuts[:-1]]
        return C.mix(total(C.mix(h + C.U64(11))) ^ C.mix(total(C.mix(h ^ C.U64(0x5851F42D4C957F2D))) + np.diff(cuts).astype(C.U64)))


def frequent_buckets(docs: DataFrame, n: int) -> np.ndarray:
    """The most frequent hash buckets of the corpus: at most FREQUENT_TABLE of 2**FREQUENT_BITS, sorted."""
    def run(batches):
        total = np.zeros(1 << FREQUENT_BITS, np.int32)
        for b in batches:
            buf, off = C.utf8(b.column(0))
            for lo, hi in C.slices(off):
                h, _ = _sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)
                np.add.at(total, (h >> C.U64(64 - FREQUENT_BITS)).astype(np.int64), 1)
        mean = total.mean()
        hot = np.flatnonzero(total >= max(12, mean + 8 * mean ** 0.5))
        yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(total[hot].astype(np.int64))], names=["bucket", "rows"])

    top = (docs.select("text").mapInArrow(run, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows"))
           .orderBy(F.desc("rows"), "bucket").limit(FREQUENT_TABLE))
    return np.array(sorted(r.bucket for r in top.select("bucket").collect()), np.int64)


def _points(h: np.ndarray, rows: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> list:
    """Group counts of each wanted set: log2 of the groups, bytes per count, counts."""
    bits = np.maximum(COARSE, np.ceil(np.log2(np.maximum(size / LOAD, 1))).astype(np.int64))
    many = 1 << bits
    base = np.cumsum(many) - many
    counts = np.bincount(base[rows] + (C.mix(h).view(np.int64) & (many[rows] - 1)), minlength=int(many.sum())) if len(size) else np.zeros(0, np.int64)
    out = []
    for i in range(len(size)):
        c = counts[base[i]:base[i] + many[i]] if wanted[i] else None
        if c is None:
            out.append(None)
            continue
        top = int(c.max())
        kind, width = ("<u1", 1) if top < 256 else ("<u2", 2) if top < 65_536 else ("<u4", 4)
        out.append(bytes([int(bits[i]), width]) + c.astype(kind).tobytes())
    return out


class Points:
    """Decoded points of many classes, at any resolution up to each one's own."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        head = off[:-1]
        self.bits = raw[head].astype(np.int64)
        width = raw[head + 1].astype(np.int64)
        self.part, self.place, self.data = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), []
        for kind in np.unique(self.bits * 8 + width):
            bits, w = int(kind) >> 3, int(kind) & 7
            rows = np.flatnonzero((self.bits == bits) & (width == w))
            at = head[rows][:, None] + 2 + np.arange(w << bits)
            self.part[rows], self.place[rows] = len(self.data), np.arange(len(rows))
            self.data.append((bits, np.ascontiguousarray(raw[at]).view(f"<u{w}")))

    def at(self, rows: np.ndarray, bits: int) -> np.ndarray:
        """(rows, 2**bits) counts."""
        out = np.zeros((len(rows), 1 << bits), np.int32)
        for k, (own, data) in enumerate(self.data):
            here = np.flatnonzero(self.part[rows] == k)
            if len(here):
                fine = data[self.place[rows[here]]]
                out[here] = fine.reshape(len(here), 1 << (own - bits), 1 << bits).sum(1, dtype=np.int32)
        return out

    def allowed(self, other: "Points", i, j, size_i, size_j, num, den) -> np.ndarray:
        """Whether the pairs' summed minima, at their finest common resolution, reach the overlap they need."""
        ok = (size_i * den >= num * size_j) & (size_j * den >= num * size_i)
        common = np.minimum(self.bits[i], other.bits[j])
        for bits in np.unique(common[ok]).tolist():
            pick = np.flatnonzero(ok & (common == bits))
            step = max(1, (1 << 20) >> bits)
            for lo in range(0, len(pick), step):
                p = pick[lo:lo + step]
                over = np.minimum(self.at(i[p], bits), other.at(j[p], bits)).sum(1)
                ok[p] = over >= _need(size_i[p], size_j[p], num, den)
        return ok


def sketches(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, cls, n, prefix shingles (once per class and task) and group counts of every row."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        seen: set = set()
        hot_table = table.value
        for b in batches:
            buf, off = C.utf8(b.column(1))
            for lo, hi in C.slices(off):
                m = hi - lo
                h, rows = _sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)
                cuts = np.searchsorted(rows, np.arange(m + 1))
                size = np.diff(cuts)
                cls = _class_ids(h, cuts)
                bucket = (h >> C.U64(64 - FREQUENT_BITS)).astype(np.int64)
                at = np.minimum(np.searchsorted(hot_table, bucket), max(len(hot_table) - 1, 0))
                hot = hot_table[at] == bucket if len(hot_table) else np.zeros(len(h), bool)
                order = np.lexsort((h, hot, rows))
                rank = np.arange(len(h)) - cuts[rows]
                prefix = np.where(size > 0, size - -(-num * size // den) + 1, 0)
                fresh = np.zeros(m, bool)
                for i, c in enumerate(cls.tolist()):
                    if size[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                take = (rank < prefix[rows]) & fresh[rows]
                keys = h[order][take].view(np.int64)
                lengths = np.where(fresh, prefix, 0)
                point = _points(h, rows, size, fresh)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, m), pa.array(cls.view(np.int64)), pa.array(size.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(keys)),
                     pa.array(point, pa.binary())],
                    names=["doc_id", "cls", "n", "keys", "point"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, cls long, n long, keys array<long>, point binary")


def _grouped(batches, num: int, den: int):
    """Rows sorted by (key, n, cls) -> members of groups of two or more classes, with the group's size."""
    left = None
    for b in [*_marked(batches)]:
        rows, last = b
        if left is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(left, rows)]
        key, n, cls = rows
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (n[:-1] * den < num * n[1:])
        edges = np.flatnonzero(new)
        if not last:        # the final group may go on in the next batch
            cut = edges[-1]
            left = [x[cut:] for x in rows]
            key, n, cls, edges = key[:cut], n[:cut], cls[:cut], edges[:-1]
            if not cut:
                continue
        again = np.zeros(len(key), bool)
        again[1:] = (cls[1:] == cls[:-1]) & (key[1:] == key[:-1])
        group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, len(key))))
        distinct = np.bincount(group[~again], minlength=len(edges))
        gid = C.mix(key.view(C.U64) + n[edges][group].astype(C.U64) * C.U64(0x9E3779B97F4A7C15)).view(np.int64)
        ok = ~again & (distinct[group] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(gid[ok]), pa.array(cls[ok]), pa.array(distinct[group][ok])], names=["gid", "cls", "members"])


def _marked(batches):
    """(columns, is it the last) of each batch, reading one ahead."""
    held = None
    for b in batches:
        if held is not None:
            yield held, False
        held = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
    if held is not None:
        yield held, True


def groups(sketch: DataFrame, num: int, den: int) -> DataFrame:
    """gid, cls, members (classes of the group) of all groups of two or more classes that share a prefix shingle."""
    k = sketch.select(F.explode("keys").alias("key"), "n", "cls")
    k = k.repartition(C.partitions(sketch.sparkSession), "key").sortWithinPartitions("key", "n", "cls")
    return k.mapInArrow(lambda it: _grouped(it, num, den), "gid long, cls long, members long")


# ---------------------------------------------------------------- the R-tree

def _pack(points: np.ndarray, size: np.ndarray):
    """Leaves of an R-tree packed by size, then by the two most spread coordinates (sort-tile order)."""
    k = len(size)
    order = np.argsort(size, kind="stable")
    spread = np.argsort(-points.std(0), kind="stable")[:2]
    tile = max(LEAF, int(np.ceil(k / max(1, round((k / LEAF) ** (1 / 3))))))
    out = []
    for lo in range(0, k, tile):
        slab = order[lo:lo + tile]
        slab = slab[np.argsort(points[slab, spread[0]], kind="stable")]
        inner = max(LEAF, int(np.ceil(len(slab) ** 0.5 / LEAF)) * LEAF)
        for a in range(0, len(slab), inner):
            run = slab[a:a + inner]
            run = run[np.argsort(points[run, spread[1]], kind="stable")]
            out += [run[c:c + LEAF] for c in range(0, len(run), LEAF)]
    return out


def _need(a, b, num, den):
    """Smallest overlap of sets of sizes a and b at the threshold."""
    return -(-num * (a + b) // (num + den))


def tree_pairs(points: np.ndarray, size: np.ndarray, comp: np.ndarray, num: int, den: int):
    """Index pairs of different components whose summed coordinate minima allow a link."""
    leaves = _pack(points, size)
    top = np.stack([points[l].max(0) for l in leaves])
    low = np.array([size[l].min() for l in leaves])
    high = np.array([size[l].max() for l in leaves])
    one = np.array([comp[l[0]] if (comp[l] == comp[l[0]]).all() else np.iinfo(np.int64).min for l in leaves])
    nodes = [np.arange(i, min(i + FAN, len(leaves))) for i in range(0, len(leaves), FAN)]
    node_top = np.stack([top[x].max(0) for x in nodes])
    node_low = np.array([low[x].min() for x in nodes])
    node_high = np.array([high[x].max() for x in nodes])
    found = []
    for i, x in enumerate(nodes):
        bound = np.minimum(node_top[i], node_top[i:]).sum(1)
        go = (bound >= _need(node_low[i], node_low[i:], num, den)) & (
            node_high[i] * den >= num * node_low[i:]) & (node_high[i:] * den >= num * node_low[i])
        for j in np.flatnonzero(go) + i:
            for p in x:
                q = nodes[j][nodes[j] >= p]
                ok = (np.minimum(top[p], top[q]).sum(1) >= _need(low[p], low[q], num, den)) & (
                    high[p] * den >= num * low[q]) & (high[q] * den >= num * low[p]) & (
                    (one[p] != one[q]) | (one[p] == np.iinfo(np.int64).min))
                for m in q[ok]:
                    a, b = leaves[p], leaves[m]
                    over = np.minimum(points[a][:, None], points[b][None]).sum(2)
                    hit = (over >= _need(size[a][:, None], size[b][None], num, den)) & (comp[a][:, None] != comp[b][None])
                    if p == m:
                        hit = np.triu(hit, 1)
                    u, v = np.nonzero(hit)
                    found.append(np.stack([a[u], b[v]]))
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


def _group_pairs(gid, comp, points, size, num, den):
    """Candidate index pairs within groups of equal ``gid`` (sorted): small groups directly, large ones by the tree."""
    edges = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1], [True]]))
    length = np.diff(edges)
    few = np.repeat(length <= DIRECT, length)
    pairs = []
    for d in range(1, DIRECT):
        i = np.flatnonzero(few[:-d] & (gid[d:] == gid[:-d]) & (comp[d:] != comp[:-d])) if len(gid) > d else np.zeros(0, np.int64)
        pairs.append(np.stack([i, i + d]))
    coarse = None
    for lo, hi in zip(edges[:-1][length > DIRECT], edges[1:][length > DIRECT]):
        if coarse is None:
            coarse = points.at(np.arange(len(gid)), COARSE)
        pairs.append(lo + tree_pairs(coarse[lo:hi], size[lo:hi], comp[lo:hi], num, den))
    return np.concatenate(pairs, 1)


def _tree_join(batches, num, den):
    """Rows (gid, cls, comp, n, point, gids) sorted by gid -> candidate pairs, each from the first group its classes share.

    ``gids`` holds the ``SHARED`` smallest groups of a class. If two such lists meet at
    all, their smallest common member is the first common group; else every common
    group reports the pair.
    """
    def work(gid, cls, comp, size, lists, raw, off):
        points = Points(raw, off)
        i, j = _group_pairs(gid, comp, points, size, num, den)
        # a pair of classes may share many groups: bound it once, at its first group here
        a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
        order = np.lexsort((gid[i], b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        i, j = i[order[new]], j[order[new]]
        ok = points.allowed(points, i, j, size[i], size[j], num, den)
        i, j = i[ok], j[ok]
        first = np.ones(len(i), bool)
        for k, (u, v) in enumerate(zip(i.tolist(), j.tolist())):
            common = lists[u] & lists[v]
            first[k] = not common or min(common) == gid[u]
        a, b = cls[i[first]], cls[j[first]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    left = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        lists = np.empty(batch.num_rows, object)
        for k, x in enumerate(batch.column(5).to_pylist()):
            lists[k] = frozenset(x)
        rows.append(lists)
        raw, off = C.utf8(batch.column(4))
        if left is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(left[0], rows)]
            off = np.concatenate([left[2], off[1:] + left[2][-1]])
            raw = np.concatenate([left[1], raw])
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        left = [x[cut:] for x in rows], raw[off[cut]:], off[cut:] - off[cut]
        if cut:
            yield work(*[x[:cut] for x in rows], raw[:off[cut]], off[:cut + 1])
    if left is not None and len(left[0][0]):
        yield work(*left[0], left[1], left[2])


# ---------------------------------------------------------------- verification and assembly

def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table only after counting it; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def verify(pairs: DataFrame, docs: DataFrame, sketch: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole shingle sets reach the threshold."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.lit(True).alias("is_a")),
                                           F.struct(F.col("b").alias("cls"), F.lit(False).alias("is_a")))).alias("s")).select("s.*")
    wanted = sides.groupBy("cls").agg(F.max("is_a").alias("as_a"), F.max(~F.col("is_a")).alias("as_b"))
    home = C.store(sketch.select("cls", "doc_id").join(wanted, "cls").groupBy("cls", "as_a", "as_b").agg(F.min("doc_id").alias("_id")), "homes")
    ids = small(home.select("_id").distinct())
    texts = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")

    def run(batches):
        for b in batches:
            buf, off = C.utf8(b.column(1))
            for lo, hi in C.slices(off):
                h, rows = _sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], n)
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_class_ids(h, cuts).view(np.int64)),
                     pa.array([h[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["cls", "tokens"])

    # a doc_id that occurs with several texts gives several sets; the join with the wanted classes keeps the right ones
    sets = C.store(texts.mapInArrow(run, "cls long, tokens binary").join(small(home.select("cls", "as_a", "as_b")), "cls"), "sets")
    one = pairs.join(sets.where("as_b").select(F.col("cls").alias("b"), F.col("tokens").alias("right")), "b")
    two = one.join(sets.where("as_a").select(F.col("cls").alias("a"), F.col("tokens").alias("left")), "a")

    def check(batches):
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, C.U64), np.frombuffer(t, C.U64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(both * den >= num * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)

    return C.store(two.select("a", "b", "left", "right").mapInArrow(check, "a long, b long"), "verified")


def ngram_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per row; texts link when den * intersection >= num * union."""
    C.ship(docs.sparkSession)
    sketch = C.store(sketches(docs, n, num, den, frequent_buckets(docs, n)), "sketch")
    members = C.store(groups(sketch, num, den), "groups")
    points = C.store(sketch.where("point is not null").select("cls", "n", "point").dropDuplicates(["cls"]), "points")
    star = stars(members)
    star = C.store(_bounded(star, points, num, den), "star")
    links = verify(star, docs, sketch, n, num, den)
    label = components(links)
    member = (members.select("gid", "cls").join(label.withColumnRenamed("node", "cls"), "cls", "left")
              .select("gid", "cls", F.coalesce("label", "cls").alias("comp")))
    # groups with the same members are joined once
    kinds = (member.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("k"),
                                       F.bit_xor(F.xxhash64("cls")).alias("who"), F.sum(F.xxhash64("cls", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("also")))
    mixed = kinds.where("x <> y").groupBy("k", "who", "also").agg(F.min("gid").alias("gid")).select("gid")
    member = C.store(member.join(mixed, "gid"), "mixed")
    lists = member.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("gid")), 1, SHARED).alias("gids"))
    rows = (member.join(points, "cls").join(lists, "cls").select("gid", "cls", "comp", "n", "point", "gids")
            .repartition(C.partitions(docs.sparkSession), "gid").sortWithinPartitions("gid"))
    pairs = rows.mapInArrow(lambda it: _tree_join(it, num, den), "a long, b long").distinct()
    pairs = C.store(pairs.join(star, ["a", "b"], "left_anti"), "candidates")
    if pairs.limit(1).collect():
        more = verify(pairs, docs, sketch, n, num, den)
        if more.limit(1).collect():
            label = components(links.unionByName(more))
    rows = (sketch.select("doc_id", "cls", "n").join(label.withColumnRenamed("node", "cls"), "cls", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "cls").alias("_c")))
    least = rows.where("n_shingles > 0").groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    return (rows.join(least, "_c", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of every group's centre with its other members.

    The centre is the member that meets the most others over all its groups: among
    edited copies that is the text they were made from, whose own copies all reach it.
    """
    weight = members.groupBy("cls").agg(F.sum("members").alias("weight"))
    known = members.select("gid", "cls").join(weight, "cls")
    centre = known.groupBy("gid").agg(F.max(F.struct("weight", F.col("cls").alias("centre"))).alias("c")).select("gid", "c.centre")
    pairs = members.select("gid", "cls").join(centre, "gid").where("cls <> centre")
    return pairs.select(F.least("centre", "cls").alias("a"), F.greatest("centre", "cls").alias("b")).distinct()


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose summed coordinate minima allow a link."""
    def run(batches):
        for b in batches:
            x, y = Points(*C.utf8(b.column(3))), Points(*C.utf8(b.column(5)))
            n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            at = np.arange(b.num_rows)
            keep = x.allowed(y, at, at, n, m, num, den)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda key, n, p: points.select(F.col("cls").alias(key), F.col("n").alias(n), F.col("point").alias(p))
    two = pairs.join(side("a", "n", "left"), "a").join(side("b", "m", "right"), "b")
    return two.select("a", "b", "n", "left", "m", "right").mapInArrow(run, "a long, b long")


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (4 words, 85 of 100)."""
    return ngram_components(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
