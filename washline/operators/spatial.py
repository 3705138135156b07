"""Points against polygon layers: containment (J-2), nearest distance (J-3), merge back (J-1).

Polygons enter as an edge table ``(layer keys..., poly_id, ring_id, edge_id, x1, y1, x2, y2)``
(see ``sources.roads.polygon_edges_from_wkt`` / ``ring_edges``). Points are
``(keys..., id, x, y)`` in the same planar units.

Neither operator pairs every point with every edge. Edges are registered in the grid
cells they cross, so the tables grow with edges and cells crossed, not with areas:

* containment knows for each polygon the parity of the cell corners on every grid
  line (the sorted crossings of the line are inside intervals, stored as dyadic
  ranges of cells). A point takes its corner's parity and flips it for every edge of
  its own cell between corner and point; a cell that no edge of a polygon crosses
  shares its corner's verdict;
* distance searches a pyramid of cells that hold edges, from the top down: each
  occupied point cell keeps the nodes that can hold a nearest edge, and replaces them
  by their children, until the edges of the lowest level are left.

The edges of a cell travel with its points as bytes and are worked out for whole Arrow
batches, ``PAIRS`` pairs of point and edge at a time.

The grid is shifted by an irrational fraction of a cell, so vertices at round
coordinates do not fall on its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.functions import point_segment_distance
from washline.session import ship_package

BROADCAST_EDGE_LIMIT = 500_000
SHIFT_X, SHIFT_Y = 0.38196601125010515, 0.2360679774997897
PAD = 1e-6          # of a cell: edges this close to a cell are registered in it, too
PAIRS = 1 << 18


def _maybe_broadcast(df: DataFrame, limit: int = BROADCAST_EDGE_LIMIT) -> DataFrame:
    """Broadcast hint only for a side whose row count is within ``limit``."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def _scaled(c, cell: float, shift: float) -> Column:
    """Coordinate in cells of the shifted grid."""
    return (F.col(c) if isinstance(c, str) else c) / F.lit(float(cell)) - F.lit(shift)


def _floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def with_cells(points: DataFrame, cell: float) -> DataFrame:
    """Add the cell (``_cx``, ``_cy``) of every point."""
    return points.withColumn("_cx", _floor(_scaled("x", cell, SHIFT_X))).withColumn("_cy", _floor(_scaled("y", cell, SHIFT_Y)))


def edge_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Every edge once per grid cell it crosses: row by row of the grid, the cells between its ends there."""
    low, high = _scaled(F.least("y1", "y2"), cell, SHIFT_Y), _scaled(F.greatest("y1", "y2"), cell, SHIFT_Y)
    e = edges.withColumn("_cy", F.explode(F.sequence(_floor(low - PAD), _floor(high + PAD))))
    y1, y2 = _scaled("y1", cell, SHIFT_Y), _scaled("y2", cell, SHIFT_Y)
    x1, x2 = _scaled("x1", cell, SHIFT_X), _scaled("x2", cell, SHIFT_X)
    bottom = F.greatest(F.col("_cy") - F.lit(PAD), F.least(y1, y2))
    top = F.least(F.col("_cy") + F.lit(1 + PAD), F.greatest(y1, y2))
    rise = F.when(y2 != y1, (x2 - x1) / F.when(y2 != y1, y2 - y1).otherwise(F.lit(1.0)))
    xa = F.coalesce(x1 + (bottom - y1) * rise, F.least(x1, x2))
    xb = F.coalesce(x1 + (top - y1) * rise, F.greatest(x1, x2))
    left = F.greatest(F.least(xa, xb), F.least(x1, x2)) - PAD
    right = F.least(F.greatest(xa, xb), F.greatest(x1, x2)) + PAD
    return e.withColumn("_cx", F.explode(F.sequence(_floor(F.least(left, right)), _floor(F.greatest(left, right)))))


# --- edges as bytes ------------------------------------------------------------

def _items(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and how many each list has (none where it is NULL)."""
    return lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _to_bytes(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per entry of ``counts``: so many rows of doubles; NULL where there are none."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * rows.shape[1] * 8
    parts = rows.tobytes()
    return pa.array([parts[a:b] if b > a else None for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())


def _from_bytes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``_to_bytes`` back: the rows of all values and how many each has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    parts = [b"" if v is None else v for v in column.to_pylist()]
    counts = np.array([len(v) for v in parts], np.int64) // (8 * width)
    return np.frombuffer(b"".join(parts), float).reshape(-1, width), counts


def _with_bytes(cells: DataFrame, lists: str, out: str, pack) -> DataFrame:
    """``cells`` with ``out``, the bytes that ``pack`` makes of the column ``lists``."""
    ship_package(cells.sparkSession)
    return cells.withColumn(out, F.arrow_udf(pack, "binary")(lists))


def _pieces(counts: np.ndarray):
    """Slices of consecutive points with about ``PAIRS`` pairs each."""
    ends, lo = np.cumsum(counts), 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        yield lo, hi, int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
        lo = hi


def _edge_bytes(edges: pa.Array) -> pa.Array:
    """Bytes of x1, y1, x2, y2 of lists of edges."""
    flat, counts = _items(edges)
    return _to_bytes(np.stack([_numbers(flat.field(c)) for c in ("x1", "y1", "x2", "y2")], 1), counts)


def _polygon_bytes(polys: pa.Array) -> pa.Array:
    """Bytes of x1, y1, x2, y2, place of the polygon in its list, side of the corner of lists of polygons."""
    flat, counts = _items(polys)
    edges, each = _items(flat.field("e"))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [_numbers(edges.field(c)) for c in ("x1", "y1", "x2", "y2")]
    parts += [np.repeat(v, each) for v in (place.astype(float), _numbers(flat.field("c")))]
    total = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
    return _to_bytes(np.stack(parts, 1), np.diff(total))


def _nearest(x: pa.Array, y: pa.Array, edges: pa.Array) -> pa.Array:
    """Distance to the nearest of the point's edges (as ``point_segment_distance``); NULL without one."""
    e, counts = _from_bytes(edges, 4)
    px, py = _numbers(x), _numbers(y)
    out = np.zeros(len(counts))
    for lo, hi, a, b in _pieces(counts):
        n = counts[lo:hi]
        some = np.flatnonzero(n)
        if not len(some):
            continue
        x1, y1, x2, y2 = e[a:b].T
        qx, qy = np.repeat(px[lo:hi], n), np.repeat(py[lo:hi], n)
        dx, dy = x2 - x1, y2 - y1
        len2 = dx * dx + dy * dy
        flat = len2 == 0
        t = np.where(flat, 0.0, np.maximum(0.0, np.minimum(1.0, ((qx - x1) * dx + (qy - y1) * dy) / np.where(flat, 1.0, len2))))
        fx, fy = qx - (x1 + t * dx), qy - (y1 + t * dy)
        out[lo:hi][some] = np.minimum.reduceat(np.sqrt(fx * fx + fy * fy), (np.cumsum(n) - n)[some])
    return pa.array(out, mask=counts == 0)


def _flips(cell: float, x: pa.Array, y: pa.Array, cx: pa.Array, cy: pa.Array, polys: pa.Array):
    """Per piece of points: (point, corner, flips) of every polygon of each point's cell, in the polygons' order."""
    e, counts = _from_bytes(polys, 6)
    # a point without a cell meets no polygon; its place is not read
    px, py, col, row = (_numbers(v.fill_null(0)) for v in (x, y, cx, cy))
    left, low = (col + SHIFT_X) * cell, (row + SHIFT_Y) * cell
    for lo, hi, a, b in _pieces(counts):
        n = counts[lo:hi]
        x1, y1, x2, y2, place, corner = e[a:b].T
        of = np.repeat(np.arange(lo, hi), n)
        qx, qy, x0, y0 = px[of], py[of], left[of], low[of]
        dx, dy = x2 - x1, y2 - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            y_at = y1 + (x0 - x1) * dy / dx
            x_at = x1 + (qy - y1) * dx / dy
        up = ((x1 > x0) != (x2 > x0)) & (y_at > y0) & (y_at <= qy)          # from the corner up to the point's height
        across = ((y1 > qy) != (y2 > qy)) & (x_at > x0) & ~(qx < x_at)      # and from there to the point
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(first)
        n_flips = np.add.reduceat(up.astype(np.int64) + across, at) if len(at) else np.zeros(0, np.int64)
        yield of[at], corner[at].astype(np.int64), n_flips


def _odd_side(cell: float):
    """Whether a point lies inside one of the polygons whose edges cross its cell."""
    def odd(x: pa.Array, y: pa.Array, cx: pa.Array, cy: pa.Array, polys: pa.Array) -> pa.Array:
        out = np.zeros(len(x), bool)
        for point, corner, n in _flips(cell, x, y, cx, cy, polys):
            out[point[(n + corner) % 2 == 1]] = True
        return pa.array(out)
    return F.arrow_udf(odd, "boolean")


def _flip_counts(cell: float):
    """How many edges of each polygon lie between the cell's corner and the point."""
    def flips(x: pa.Array, y: pa.Array, cx: pa.Array, cy: pa.Array, polys: pa.Array) -> pa.Array:
        each, found = np.zeros(len(x), np.int64), [np.zeros(0, np.int64)]
        for point, _, n in _flips(cell, x, y, cx, cy, polys):
            each += np.bincount(point, minlength=len(x))
            found.append(n)
        ends = np.concatenate([[0], np.cumsum(each)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
    return F.arrow_udf(flips, "array<int>")


# --- J-2 -----------------------------------------------------------------------

def _dyadic(lo: str, hi: str) -> Column:
    """Array of (level, index): the whole range [lo, hi] of integers as maximal dyadic blocks."""
    return F.expr(f"""aggregate(sequence(0, 62),
        named_struct('a', {lo}, 'b', {hi}, 'out', cast(array() as array<struct<level: int, idx: bigint>>)),
        (s, l) -> CASE WHEN s.a > s.b THEN s ELSE named_struct(
            'a', shiftright(s.a + (s.a & 1L), 1), 'b', shiftright(s.b - (1L - (s.b & 1L)), 1),
            'out', concat(s.out,
                CASE WHEN s.a & 1L = 1L THEN array(named_struct('level', l, 'idx', s.a)) ELSE array() END,
                CASE WHEN s.b & 1L = 0L AND s.b >= s.a + (s.a & 1L) THEN array(named_struct('level', l, 'idx', s.b)) ELSE array() END)) END,
        s -> s.out)""")


def corner_ranges(edges: DataFrame, cell: float, layer: list[str]) -> DataFrame:
    """(layer, poly_id, _cy, level, idx): cells whose lower left corner lies inside the polygon, as dyadic ranges of a grid row."""
    y1, y2 = _scaled("y1", cell, SHIFT_Y), _scaled("y2", cell, SHIFT_Y)
    first, last = F.ceil(F.least(y1, y2)).cast("long"), _floor(F.greatest(y1, y2))
    on_line = edges.where(first <= last).withColumn("_cy", F.explode(F.sequence(first, last)))
    line = (F.col("_cy") + F.lit(SHIFT_Y)) * F.lit(float(cell))
    on_line = on_line.where((F.col("y1") > line) != (F.col("y2") > line))
    x_at = F.col("x1") + (line - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    rows = on_line.groupBy(*layer, "poly_id", "_cy").agg(F.sort_array(F.collect_list(_scaled(x_at, cell, SHIFT_X))).alias("_xs"))
    pair = F.explode(F.expr("transform(sequence(0, size(_xs) div 2 - 1), k -> named_struct("
                            "'a', cast(ceil(_xs[2 * k]) as bigint), 'b', cast(ceil(_xs[2 * k + 1]) as bigint) - 1L))"))
    ranges = rows.where(F.size("_xs") > 1).select(*layer, "poly_id", "_cy", pair.alias("r")).where("r.a <= r.b")
    blocks = ranges.select(*layer, "poly_id", "_cy", F.explode(_dyadic("r.a", "r.b")).alias("d"))
    return blocks.select(*layer, "poly_id", "_cy", F.col("d.level").alias("level"), F.col("d.idx").alias("idx"))


def point_in_polygons(points: DataFrame, edges: DataFrame, layer: list[str], id_col: str = "id",
                      band: float = 25.0, out: str = "Inundated", keep_all: bool = True,
                      repeated: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """J-2: ``out`` = point lies inside any polygon of its layer (even-odd; boundary up to ray-rule ties).

    ``band`` is the cell size. Returns ``points`` with the flag added (points meeting
    no polygon get False), or, with ``keep_all=False``, only the (layer, id) keys of
    points that are inside. ``repeated``: what ``repeated_ids`` found, and for which keys.
    """
    from washline.plans.common import materialize

    cell, place = float(band), [*layer, "_cx", "_cy"]
    p = with_cells(points.select(*layer, id_col, "x", "y"), cell)
    occupied = materialize(p.select(*place).distinct())
    ranges = materialize(corner_ranges(edges, cell, layer))
    levels = sorted(r.level for r in ranges.select("level").distinct().collect())       # at most 63
    probes = occupied.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    probes = probes.withColumn("idx", F.expr("shiftright(_cx, level)"))
    corners = materialize(probes.join(ranges, [*layer, "_cy", "level", "idx"]).select(*place, "poly_id").distinct())
    ec = edge_cells(edges, cell).select(*place, "poly_id", "x1", "y1", "x2", "y2").join(occupied, place, "left_semi")
    ec = materialize(ec.join(corners.withColumn("_corner", F.lit(1)), [*place, "poly_id"], "left").fillna(0, ["_corner"]))
    # no edge of the polygon in the cell: all its points share the corner's side
    full = corners.join(ec.select(*place, "poly_id").distinct(), [*place, "poly_id"], "left_anti").select(*place).distinct()
    polys = ec.groupBy(*place, "poly_id").agg(F.max("_corner").alias("c"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("e"))
    polys = polys.groupBy(*place).agg(F.collect_list(F.struct("poly_id", "c", "e")).alias("_polys"))
    polys = _with_bytes(polys, "_polys", "_bytes", _polygon_bytes)
    at = _whole_cells(polys.join(full.withColumn("_full", F.lit(True)), place, "full"), ec)
    # the edges of a point's cell come with its row: no pair of point and edge is ever shuffled
    met = with_cells(points, cell).join(at, place, "left")
    odd = F.when(F.col("_bytes").isNotNull(), _odd_side(cell)("x", "y", "_cx", "_cy", "_bytes"))
    flagged = met.withColumn("_odd", odd).withColumn(out, F.coalesce(F.col("_full"), F.lit(False)) | F.coalesce(F.col("_odd"), F.lit(False)))

    def together(rows: DataFrame) -> DataFrame:
        """Rows that share an id are one point: their flips add up."""
        sides = rows.where("_bytes is not null").withColumn("_flips", _flip_counts(cell)("x", "y", "_cx", "_cy", "_bytes"))
        sides = sides.select(*layer, id_col, F.explode(F.arrays_zip("_polys", F.col("_flips").alias("n"))).alias("s"))
        each = sides.groupBy(*layer, id_col, "s._polys.poly_id").agg((F.sum("s.n") + F.max("s._polys.c")).alias("_n")).where("_n % 2 = 1")
        return each.select(*layer, id_col).unionByName(rows.where("_full").select(*layer, id_col)).distinct().withColumn(out, F.lit(True))

    keep = [*points.columns, out]
    flagged = _by_id(flagged, keep, layer, id_col, repeated, out, together, F.lit(False))
    return flagged if keep_all else flagged.where(F.col(out)).select(*layer, id_col, out).distinct()


def repeated_ids(points: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes (``_h``) of the keys that occur more than once (with them, at worst, a few that share a hash)."""
    from washline.plans.common import materialize
    return materialize(points.select(F.xxhash64(*keys).alias("_h")).groupBy("_h").count().where("count > 1").select("_h"))


def _whole_cells(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """A table of a row per cell, broadcast only if the ``rows`` gathered in it are few."""
    from washline.plans.common import materialize
    small = rows.limit(BROADCAST_EDGE_LIMIT + 1).count() <= BROADCAST_EDGE_LIMIT
    cells = materialize(cells)
    return _maybe_broadcast(cells) if small else cells


def _by_id(rows: DataFrame, keep: list[str], layer: list[str], id_col: str, repeated: tuple[DataFrame, list[str]] | None, out: str, together, missing: Column) -> DataFrame:
    """``rows`` whose ``out`` holds for their id: rows with an id of their own keep it, without a shuffle; ``together`` settles the others."""
    hashes, keys = repeated or (repeated_ids(rows, [*layer, id_col]), [*layer, id_col])
    h = F.xxhash64(*keys)
    value = F.when(F.col(id_col).isNotNull(), F.col(out)).otherwise(missing)          # no id: no answer
    if not hashes.limit(1).collect():
        return rows.withColumn(out, value).select(*keep)
    hashes = _maybe_broadcast(hashes)
    single = rows.withColumn("_h", h).join(hashes, "_h", "left_anti").withColumn(out, value).select(*keep)
    several = rows.withColumn("_h", h).join(hashes, "_h", "left_semi")
    back = several.drop(out).join(together(several), [*layer, id_col], "left").withColumn(out, F.coalesce(F.col(out), missing))
    return single.unionByName(back.select(*keep))


# --- J-3 -----------------------------------------------------------------------

def _gaps(level: int) -> tuple[Column, Column]:
    """Least and largest distance, in cells, between a point cell and a node of ``level``."""
    size = 1 << level
    near, far = [], []
    for c, n in (("_cx", "_nx"), ("_cy", "_ny")):
        begin = F.col(n) * F.lit(size)
        near.append(F.greatest(F.lit(0), begin - F.col(c) - 1, F.col(c) - begin - size).cast("double"))
        far.append(F.greatest(begin + size - F.col(c), F.col(c) + 1 - begin).cast("double"))
    return F.sqrt(near[0] * near[0] + near[1] * near[1]), F.sqrt(far[0] * far[0] + far[1] * far[1]) * (1 + PAD) + PAD


def nearest_edge_candidates(cells: DataFrame, edges: DataFrame, layer: list[str], cell: float) -> DataFrame:
    """For each occupied cell, a set of edges that contains the nearest edge of every point in it.

    Top-down over a pyramid of the cells that hold edges: at each level the smallest
    of the largest distances bounds the nearest distance of every point of the cell,
    and nodes that are farther off than that go, before the rest is replaced by its children.
    """
    from washline.plans.common import materialize

    place = [*layer, "_cx", "_cy"]
    ec = materialize(edge_cells(edges, cell).select(*place, "poly_id", "ring_id", "edge_id", "x1", "y1", "x2", "y2"))
    nodes = {0: materialize(ec.select(*layer, F.col("_cx").alias("_nx"), F.col("_cy").alias("_ny")).distinct())}
    todo = cells.select(*place).distinct().join(edges.select(*layer).distinct(), layer, "left_semi")
    size = nodes[0].agg(*[f(c).alias(f"{c}{i}") for c in ("_nx", "_ny") for i, f in enumerate((F.min, F.max))]).first()
    span = max(1, (size["_nx1"] or 0) - (size["_nx0"] or 0), (size["_ny1"] or 0) - (size["_ny0"] or 0))
    top = span.bit_length()             # at most two nodes on each axis
    for level in range(1, top + 1):
        nodes[level] = nodes[level - 1].select(*layer, F.shiftright("_nx", 1).alias("_nx"), F.shiftright("_ny", 1).alias("_ny")).distinct()
    kept = todo.join(_maybe_broadcast(nodes[top]), layer)     # at most four nodes a layer, but any number of layers
    for level in range(top, -1, -1):
        near, far = _gaps(level)
        kept = kept.withColumn("_near", near).withColumn("_far", far)
        bound = kept.groupBy(*place).agg(F.min("_far").alias("_u"))
        kept = materialize(kept.join(bound, place).where("_near <= _u").select(*place, "_nx", "_ny"))
        if level:
            child = nodes[level - 1].select(*layer, F.shiftright("_nx", 1).alias("_px"), F.shiftright("_ny", 1).alias("_py"), "_nx", "_ny")
            kept = (kept.withColumnRenamed("_nx", "_px").withColumnRenamed("_ny", "_py")
                    .join(_maybe_broadcast(child), [*layer, "_px", "_py"]).select(*place, "_nx", "_ny"))
    found = kept.join(_maybe_broadcast(ec.withColumnRenamed("_cx", "_nx").withColumnRenamed("_cy", "_ny")), [*layer, "_nx", "_ny"])
    cand = materialize(found.select(*place, "poly_id", "ring_id", "edge_id", "x1", "y1", "x2", "y2").distinct())
    # keep only edges whose bounding box can come closer to the cell than its bound
    x0, y0 = (F.col("_cx") + F.lit(SHIFT_X)) * F.lit(float(cell)), (F.col("_cy") + F.lit(SHIFT_Y)) * F.lit(float(cell))
    corners = [(x0, y0), (x0 + cell, y0), (x0, y0 + cell), (x0 + cell, y0 + cell)]
    dmax = F.greatest(*[point_segment_distance(cx, cy, "x1", "y1", "x2", "y2") for cx, cy in corners])
    bound = cand.groupBy(*place).agg((F.min(dmax) * (1 + PAD)).alias("_u"))
    gap_x = F.greatest(F.lit(0.0), F.least("x1", "x2") - (x0 + cell), x0 - F.greatest("x1", "x2"))
    gap_y = F.greatest(F.lit(0.0), F.least("y1", "y2") - (y0 + cell), y0 - F.greatest("y1", "y2"))
    return materialize(cand.join(bound, place).where(F.sqrt(gap_x * gap_x + gap_y * gap_y) <= F.col("_u")).drop("_u"))


def distance_to_polygons(points: DataFrame, edges: DataFrame, layer: list[str], id_col: str = "id",
                         cell: float = 25.0, out: str = "distance", keep_all: bool = True,
                         repeated: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """J-3: distance from each point to the nearest polygon edge of its layer (exact).

    Points of a layer without polygons get NULL. Callers set 0 for points that
    are inside (``inundated_distance='zero'``) or NULL (``'max'`` then P-11).
    """
    from washline.plans.common import materialize

    p = with_cells(points.select(*layer, id_col, "x", "y"), cell)
    cells = materialize(p.select(*layer, "_cx", "_cy").distinct())
    cand = nearest_edge_candidates(cells, edges, layer, cell)
    place = [*layer, "_cx", "_cy"]
    near = cand.groupBy(*place).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    near = _whole_cells(_with_bytes(near, "_edges", "_bytes", _edge_bytes).drop("_edges"), cand)
    met = with_cells(points, cell).join(near, place, "left")
    met = met.withColumn(out, F.arrow_udf(_nearest, "double")("x", "y", "_bytes"))

    def together(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*layer, id_col).agg(F.min(out).alias(out))

    found = _by_id(met, [*points.columns, out], layer, id_col, repeated, out, together, F.lit(None).cast("double"))
    return found if keep_all else found.where(F.col(out).isNotNull()).select(*layer, id_col, out).distinct()


def merge_back(base: DataFrame, computed: DataFrame, on: list[str], column: str) -> DataFrame:
    """J-1: replace ``column`` of ``base`` by the computed one (left join; unmatched -> NULL)."""
    return base.drop(column).join(computed.select(*on, column), on, "left")
