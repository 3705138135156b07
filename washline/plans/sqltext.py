"""SQL text builders for the oracle side of the query catalog (DuckDB dialect).

They spell out the same arithmetic as the DataFrame operators so that both
engines produce identical doubles before the final rounding.
"""

from __future__ import annotations

from washline.sources.fixtures import SEGMENTS_SQL


def r6(expr: str) -> str:
    return f"ROUND({expr}, 6)"


def div(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST(NULLIF({den}, 0) AS DOUBLE))"


def div0(num: str, den: str) -> str:
    return f"COALESCE({div(num, den)}, 0.0)"


def screening_sql(dist="Distance_to_Coast_m", rel="Rel_Elev_Min", z="Z_Min") -> str:
    return (f"CAST((CASE WHEN {dist} <= 48.06 THEN 1 ELSE 0 END + CASE WHEN {rel} <= 1.71 THEN 1 ELSE 0 END"
            f" + CASE WHEN {z} <= 3.03 THEN 1 ELSE 0 END) >= 2 AS INT)")


def label_sql(col="Damage_Status") -> str:
    return f"CAST(CASE WHEN {col} = 'Damage' THEN 1 WHEN {col} = 'No Damage' THEN 0 END AS INT)"


def counts_sql(source: str, keys: list[str], label="y", pred="y_pred") -> str:
    k = ", ".join(keys)
    return (f"SELECT {k}, count(*) FILTER (WHERE {label} = 0 AND {pred} = 0) AS tn, "
            f"count(*) FILTER (WHERE {label} = 0 AND {pred} = 1) AS fp, "
            f"count(*) FILTER (WHERE {label} = 1 AND {pred} = 0) AS fn, "
            f"count(*) FILTER (WHERE {label} = 1 AND {pred} = 1) AS tp FROM {source} GROUP BY {k}")


def metrics_select(rnd: bool = True) -> list[str]:
    """Metric expressions over columns tn, fp, fn, tp (same formulas as add_count_metrics)."""
    f = r6 if rnd else (lambda e: e)
    n = "(tn + fp + fn + tp)"
    present = "((CASE WHEN tn + fp > 0 THEN 1 ELSE 0 END) + (CASE WHEN fn + tp > 0 THEN 1 ELSE 0 END))"
    bal = div(f"(COALESCE({div('tn', 'tn + fp')}, 0.0) + COALESCE({div('tp', 'fn + tp')}, 0.0))", present)
    expected = ("(CAST(tn + fn AS DOUBLE) * CAST(fn + tp AS DOUBLE) + CAST(fp + tp AS DOUBLE) * CAST(tn + fp AS DOUBLE))")
    kappa = f"(1.0 - (CAST({n} AS DOUBLE) * CAST(fp + fn AS DOUBLE)) / NULLIF({expected}, 0))"
    return [
        f"{f(div('tn + tp', n))} AS accuracy",
        f"{f(bal)} AS balanced_accuracy",
        f"{f(kappa)} AS kappa",
        f"{f(div0('tn', 'tn + fn'))} AS precision_0",
        f"{f(div0('tn', 'tn + fp'))} AS recall_0",
        f"{f(div0('2 * tn', '2 * tn + fn + fp'))} AS f1_0",
        f"{f(div0('tp', 'fp + tp'))} AS precision_1",
        f"{f(div0('tp', 'fn + tp'))} AS recall_1",
        f"{f(div0('2 * tp', '2 * tp + fp + fn'))} AS f1_1",
        f"CAST({present} AS BIGINT) AS n_classes",
    ]


def auc_sql(source: str, keys: list[str], label="y", score="score") -> str:
    """Mean-rank AUC per group: (R1 - n1(n1+1)/2) / (n0 n1); NULL with one class."""
    k = ", ".join(keys)
    return f"""
    SELECT {k}, CASE WHEN n1 > 0 AND n0 > 0 THEN (r1 - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * CAST(n0 AS DOUBLE)) END AS auc
    FROM (
      SELECT {k}, sum(CASE WHEN {label} = 1 THEN rk + (ties - 1) / 2.0 END) AS r1,
             count(*) FILTER (WHERE {label} = 1) AS n1, count(*) FILTER (WHERE {label} = 0) AS n0
      FROM (
        SELECT {k}, {label}, rank() OVER (PARTITION BY {k} ORDER BY {score}) AS rk,
               count(*) OVER (PARTITION BY {k}, {score}) AS ties
        FROM {source} WHERE {label} IS NOT NULL AND {score} IS NOT NULL
      ) ranked GROUP BY {k}
    ) sums"""


def with_segments(*ctes: tuple[str, str]) -> str:
    """``WITH segments AS (...), name AS (...), ...``"""
    parts = [f"segments AS ({SEGMENTS_SQL})"] + [f"{name} AS ({body})" for name, body in ctes]
    return "WITH " + ",\n".join(parts)


def quota_sql(source: str, keys: list[str], label: str, frac: float) -> str:
    """Per (keys, class) test counts of the exact stratified split (same rule as class_quotas)."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}"
    return f"""
    SELECT {k}, {label}, n_class - (fl + CASE WHEN row_number() OVER ({part} ORDER BY rem DESC, n_class DESC, {label} ASC) <= need THEN 1 ELSE 0 END) AS n_test
    FROM (
      SELECT *, n_train_all - sum(fl) OVER ({part}) AS need FROM (
        SELECT *, CAST(floor(cont) AS BIGINT) AS fl, cont - floor(cont) AS rem FROM (
          SELECT *, n_class / n * n_train_all AS cont FROM (
            SELECT *, n - CAST(ceil(CAST({float(frac)!r} AS DOUBLE) * n) AS BIGINT) AS n_train_all FROM (
              SELECT {k}, {label}, n_class, sum(n_class) OVER ({part}) AS n FROM (
                SELECT {k}, {label}, count(*) AS n_class FROM {source} GROUP BY {k}, {label}) c) a) b) d) e) f"""


def md5_sql(id_col: str, salt_sql: str) -> str:
    return f"md5({id_col} || '|' || {salt_sql})"


def _feature_case(features: list[str], fi: str, prefix: str = "") -> str:
    whens = " ".join(f"WHEN {i} THEN {prefix}{f}" for i, f in enumerate(features))
    return f"(CASE {fi} {whens} END)"


def cart_ctes(train: str, features: list[str], max_depth: int, min_leaf: int, key: str = "run") -> list[tuple[str, str]]:
    """CTEs growing one CART tree per ``key`` (same rule as operators.trees.fit_cart); last CTE: ``trees``."""
    fcols = ", ".join(features)
    names = "CASE fi " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(features)) + " END"
    ctes = [("cur0", f"SELECT {key}, 0 AS node, y, {fcols} FROM {train}")]
    levels = []
    for d in range(max_depth + 1):
        cur = f"cur{d}"
        ctes.append((f"stats{d}", f"SELECT {key}, node, count(*) AS n, count(*) FILTER (WHERE y = 1) AS n_pos FROM {cur} GROUP BY {key}, node"))
        if d < max_depth:
            longs = " UNION ALL ".join(
                f"SELECT c.{key}, c.node, c.y, {i} AS fi, CAST(c.{f} AS DOUBLE) AS v FROM {cur} c JOIN stats{d} s "
                f"ON c.{key} = s.{key} AND c.node = s.node WHERE s.n_pos > 0 AND s.n_pos < s.n AND s.n >= {2 * min_leaf} AND c.{f} IS NOT NULL"
                for i, f in enumerate(features))
            ctes.append((f"long{d}", longs))
            ctes.append((f"vc{d}", f"SELECT {key}, node, fi, v, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM long{d} GROUP BY {key}, node, fi, v"))
            w = f"PARTITION BY {key}, node, fi"
            ctes.append((f"cum{d}", f"""SELECT *, sum(pos) OVER ({w} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
                sum(neg) OVER ({w} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn,
                lead(v) OVER ({w} ORDER BY v) AS v_next, sum(pos) OVER ({w}) AS P, sum(neg) OVER ({w}) AS N FROM vc{d}"""))
            score = ("(CAST(cp AS DOUBLE) * CAST(cp AS DOUBLE) + CAST(cn AS DOUBLE) * CAST(cn AS DOUBLE)) / CAST(cp + cn AS DOUBLE)"
                     " + (CAST(P - cp AS DOUBLE) * CAST(P - cp AS DOUBLE) + CAST(N - cn AS DOUBLE) * CAST(N - cn AS DOUBLE))"
                     " / CAST(P + N - cp - cn AS DOUBLE)")
            ctes.append((f"cand{d}", f"""SELECT {key}, node, fi, v, CASE WHEN v / 2.0 + v_next / 2.0 = v_next THEN v ELSE v / 2.0 + v_next / 2.0 END AS thr,
                {score} AS score FROM cum{d} WHERE cp + cn >= {min_leaf} AND P + N - cp - cn >= {min_leaf} AND v_next IS NOT NULL"""))
            ctes.append((f"best{d}", f"""SELECT {key}, node, fi, thr AS threshold FROM (
                SELECT *, row_number() OVER (PARTITION BY {key}, node ORDER BY score DESC, fi ASC, v ASC) AS rn FROM cand{d}) x WHERE rn = 1"""))
            ctes.append((f"level{d}", f"""SELECT s.{key}, s.node, {d} AS depth, b.fi IS NULL AS is_leaf, {names.replace('fi', 'b.fi', 1)} AS feature,
                b.threshold, s.n, s.n_pos, CAST(s.n_pos AS DOUBLE) / CAST(s.n AS DOUBLE) AS prob
                FROM stats{d} s LEFT JOIN best{d} b ON s.{key} = b.{key} AND s.node = b.node"""))
            ctes.append((f"cur{d + 1}", f"""SELECT c.{key}, CASE WHEN {_feature_case(features, 'b.fi', 'c.')} <= b.threshold
                THEN 2 * c.node + 1 ELSE 2 * c.node + 2 END AS node, c.y, {', '.join('c.' + f for f in features)}
                FROM {cur} c JOIN best{d} b ON c.{key} = b.{key} AND c.node = b.node"""))
        else:
            ctes.append((f"level{d}", f"""SELECT {key}, node, {d} AS depth, TRUE AS is_leaf, CAST(NULL AS VARCHAR) AS feature,
                CAST(NULL AS DOUBLE) AS threshold, n, n_pos, CAST(n_pos AS DOUBLE) / CAST(n AS DOUBLE) AS prob FROM stats{d}"""))
        levels.append(f"SELECT * FROM level{d}")
    ctes.append(("trees", " UNION ALL ".join(levels)))
    return ctes


def tree_score_ctes(rows: str, trees: str, features: list[str], keep: list[str], depth: int,
                    key: str = "run", prefix: str = "") -> list[tuple[str, str]]:
    """CTEs scoring every row with every tree (walk by joins); last CTE: ``<prefix>scored_long``."""
    k = ", ".join(f"r.{c}" for c in keep)
    f = ", ".join(f"r.{c}" for c in features)
    fmap = "CASE t.feature " + " ".join(f"WHEN '{c}' THEN r.{c}" for c in features) + " END"
    ctes = [(f"{prefix}walk0", f"SELECT {k}, {f}, g.{key}, 0 AS node FROM {rows} r CROSS JOIN (SELECT DISTINCT {key} FROM {trees}) g")]
    for d in range(depth):
        ctes.append((f"{prefix}walk{d + 1}", f"""SELECT {k}, {f}, r.{key}, CASE WHEN t.is_leaf THEN r.node
            WHEN {fmap} <= t.threshold THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node
            FROM {prefix}walk{d} r JOIN {trees} t ON r.{key} = t.{key} AND r.node = t.node"""))
    ctes.append((f"{prefix}scored_long", f"""SELECT {k}, r.{key}, t.prob AS p FROM {prefix}walk{depth} r
        JOIN {trees} t ON r.{key} = t.{key} AND r.node = t.node"""))
    return ctes


def logit_sql(p: str) -> str:
    return (f"(CASE WHEN {p} <= 0 THEN CAST('-inf' AS DOUBLE) WHEN {p} >= 1 THEN CAST('inf' AS DOUBLE) "
            f"ELSE ln({p} / (1.0 - {p})) END)")


def expit_sql(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


def seg_dist_sql(px: str, py: str, x1="x1", y1="y1", x2="x2", y2="y2") -> str:
    """Point-to-segment distance with the same operation order as functions.point_segment_distance."""
    dx, dy = f"({x2} - {x1})", f"({y2} - {y1})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = (f"(CASE WHEN {len2} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (({px} - {x1}) * {dx} + ({py} - {y1}) * {dy})"
         f" / (CASE WHEN {len2} = 0 THEN 1.0 ELSE {len2} END))) END)")
    qx, qy = f"({x1} + {t} * {dx})", f"({y1} + {t} * {dy})"
    return f"sqrt(({px} - {qx}) * ({px} - {qx}) + ({py} - {qy}) * ({py} - {qy}))"


def crossing_sql(px: str, py: str) -> str:
    return (f"(CASE WHEN (y1 > {py}) <> (y2 > {py}) THEN {px} < x1 + ({py} - y1) * (x2 - x1) / (y2 - y1) ELSE FALSE END)")


def platt_ctes(source: str, x: str = "x", y: str = "y", C: float = 1.0, iterations: int = 30) -> list[tuple[str, str]]:
    """Newton steps of the one-feature L2 logistic fit (same update as models.fit_platt); last CTE: ``platt``."""
    ctes = [("platt_it0", "SELECT CAST(0.0 AS DOUBLE) AS w, CAST(0.0 AS DOUBLE) AS b")]
    for k in range(iterations):
        p = f"(1.0 / (1.0 + exp(-(it.w * s.{x} + it.b))))"
        sums = (f"SELECT it.w, it.b, sum(({p} - s.{y}) * s.{x}) AS gw, sum({p} - s.{y}) AS gb, "
                f"sum({p} * (1.0 - {p}) * s.{x} * s.{x}) AS hww, sum({p} * (1.0 - {p}) * s.{x}) AS hwb, "
                f"sum({p} * (1.0 - {p})) AS hbb FROM platt_it{k} it CROSS JOIN {source} s GROUP BY it.w, it.b")
        c = repr(float(C))
        g_w, g_b = f"(w + {c} * gw)", f"({c} * gb)"
        h_ww, h_wb, h_bb = f"(1.0 + {c} * hww)", f"({c} * hwb)", f"({c} * hbb + 1e-300)"
        det = f"({h_ww} * {h_bb} - {h_wb} * {h_wb})"
        ctes.append((f"platt_it{k + 1}", f"""SELECT w - ({h_bb} * {g_w} - {h_wb} * {g_b}) / {det} AS w,
            b - ({h_ww} * {g_b} - {h_wb} * {g_w}) / {det} AS b FROM ({sums}) t"""))
    ctes.append(("platt", f"SELECT w, b FROM platt_it{iterations}"))
    return ctes
