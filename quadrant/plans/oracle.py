"""Reference SQL for every catalog query, written for DuckDB.

Each statement recomputes the query from the raw tables with plain SQL (list
lambdas for the polygon test), in the same floating-point operation order as
the Spark plan, so results compare bit for bit.  Doubles are written in
scientific notation: both engines read that as DOUBLE, never DECIMAL.
"""

from __future__ import annotations

from quadrant.functions.generators import MIN_X, MIN_Y, SPAN_X, SPAN_Y, X_HASH, Y_HASH
from quadrant.plans import catalog as C
from quadrant.sources.derived import KEY_X, KEY_Y


def lit(v: float) -> str:
    return "%.17e" % float(v)


def _coord(f: str, lo: float, span: float) -> str:
    return f"{lit(lo)} + {f} * {lit(span)}"


def _key_unit(u: str, h: dict) -> str:
    return f"(({u} * {h['mult']} + {h['offset']}) % {h['mod']}) / {lit(h['mod'])}"


def _points(table: str, u: str, skewed: bool = False) -> str:
    fx, fy = _key_unit(u, KEY_X), _key_unit(u, KEY_Y)
    if skewed:
        fx, fy = (f"({f}) * ({f}) * ({f}) * ({f})" for f in (fx, fy))
    return (f"SELECT {u} AS id, {_coord(fx, MIN_X, SPAN_X)} AS x, {_coord(fy, MIN_Y, SPAN_Y)} AS y "
            f"FROM {table}")


POINTS_A = _points("orders", "o_orderkey")
POINTS_B = _points("lineitem", "(l_orderkey * 8 + l_linenumber)")
POINTS_C = _points("events", "event_id")
POINTS_D = _points("events", "event_id", skewed=True)


def _gen_unit(row: str, seed: int, h: dict, corner: int = 0) -> str:
    return f"(({row} * {h['mult'][corner]} + {seed * h['seed_mult'] + h['offset'][corner]}) % {h['mod']}) / {lit(h['mod'])}"


def _query_points(n: int, seed: int) -> str:
    return (f"SELECT range AS q, {_coord(_gen_unit('range', seed, X_HASH), MIN_X, SPAN_X)} AS qx, "
            f"{_coord(_gen_unit('range', seed, Y_HASH), MIN_Y, SPAN_Y)} AS qy FROM range({n})")


def _windows(n: int, seed: int) -> str:
    x1 = _coord(_gen_unit("range", seed, X_HASH, 0), MIN_X, SPAN_X)
    x2 = _coord(_gen_unit("range", seed, X_HASH, 1), MIN_X, SPAN_X)
    y1 = _coord(_gen_unit("range", seed, Y_HASH, 0), MIN_Y, SPAN_Y)
    y2 = _coord(_gen_unit("range", seed, Y_HASH, 1), MIN_Y, SPAN_Y)
    return (f"SELECT range AS window_id, least({x1}, {x2}) AS mnx, greatest({x1}, {x2}) AS mxx, "
            f"least({y1}, {y2}) AS mny, greatest({y1}, {y2}) AS mxy FROM range({n})")


def _windows_for(table: str, key: str, seed: int, share: float) -> str:
    x1, x2 = (_coord(_gen_unit(key, seed, X_HASH, c), MIN_X, SPAN_X) for c in (0, 1))
    y1, y2 = (_coord(_gen_unit(key, seed, Y_HASH, c), MIN_Y, SPAN_Y) for c in (0, 1))
    return f"""SELECT window_id, least(x1, x2) AS mnx, greatest(x1, x2) AS mxx, least(y1, y2) AS mny, greatest(y1, y2) AS mxy FROM (
  SELECT window_id, x1, x1 + (x2 - x1) * {lit(share)} AS x2, y1, y1 + (y2 - y1) * {lit(share)} AS y2 FROM (
    SELECT {key} AS window_id, {x1} AS x1, {x2} AS x2, {y1} AS y1, {y2} AS y2 FROM {table}))"""


def _points_for(table: str, key: str, seed: int) -> str:
    return (f"SELECT {key} AS q, {_coord(_gen_unit(key, seed, X_HASH), MIN_X, SPAN_X)} AS qx, "
            f"{_coord(_gen_unit(key, seed, Y_HASH), MIN_Y, SPAN_Y)} AS qy FROM {table}")


def _horizon() -> str:
    x = lambda e: f"{lit(MIN_X)} + {e} / n * {lit(SPAN_X)}"
    y = lambda e: f"{lit(C.MIDDLE_Y)} + ({e} * 104729 + 71) % 1000033 / {lit(1000033.0)} * {lit(SPAN_Y / 2)}"
    low = lit(MIN_Y)
    return f"""
SELECT {x('e')} AS x1, {y('e')} AS y1, {x('(e + 1)')} AS x2, {y('(e + 1)')} AS y2
FROM (SELECT event_id AS e, (count(*) OVER ())::DOUBLE AS n, max(event_id) OVER () AS last FROM events) WHERE e < last
UNION ALL SELECT {x('last')}, {y('last')}, {x('last')}, {low} FROM (SELECT count(*)::DOUBLE AS n, max(event_id) AS last FROM events)
UNION ALL SELECT {x('last')}, {low}, {x('0')}, {low} FROM (SELECT count(*)::DOUBLE AS n, max(event_id) AS last FROM events)
UNION ALL SELECT {x('0')}, {low}, {x('0')}, {y('0::BIGINT')} FROM (SELECT count(*)::DOUBLE AS n, max(event_id) AS last FROM events)"""


_CROSS_ROW = "((e.x1 - p.x) * (e.y2 - p.y) - (e.x2 - p.x) * (e.y1 - p.y))"


def _many_edges(points: str, edges: str) -> str:
    """Crossings and touches summed per point row, edges as rows."""
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, id, x, y FROM ({points})), e AS MATERIALIZED ({edges})
SELECT 0::BIGINT AS window_id, any_value(p.id) AS id, any_value(p.x) AS x, any_value(p.y) AS y
FROM p JOIN e ON p.y >= least(e.y1, e.y2) AND p.y <= greatest(e.y1, e.y2) GROUP BY r
HAVING sum(CASE WHEN ((e.y1 > p.y) <> (e.y2 > p.y)) AND (({_CROSS_ROW} > 0) = (e.y2 > e.y1)) THEN 1 ELSE 0 END) % 2 = 1
    OR bool_or({_CROSS_ROW} = 0 AND p.x >= least(e.x1, e.x2) AND p.x <= greatest(e.x1, e.x2))"""


def _d2(qx: str, qy: str) -> str:
    return f"(x - {qx}) * (x - {qx}) + (y - {qy}) * (y - {qy})"


def _knn_rows(points: str, queries: str, k: int) -> str:
    """(q, rank, id, x, y, d2) by brute force."""
    return f"""
SELECT q, rank, id, x, y, d2 FROM (
  SELECT q, id, x, y, d2,
         CAST(row_number() OVER (PARTITION BY q ORDER BY d2, id) AS INTEGER) AS rank
  FROM (SELECT q, id, x, y, {_d2('qx', 'qy')} AS d2 FROM ({points}) p CROSS JOIN ({queries}) qs)
) WHERE rank <= {k}"""


def _seed_table(x: float, y: float) -> str:
    return f"SELECT CAST(0 AS BIGINT) AS q, {lit(x)} AS qx, {lit(y)} AS qy"


def _ring_edges(nn: str) -> str:
    whole = "OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""
SELECT q, CAST(rank AS INTEGER) AS seq, x AS x1, y AS y1,
       coalesce(lead(x) OVER (PARTITION BY q ORDER BY rank), first_value(x) {whole}) AS x2,
       coalesce(lead(y) OVER (PARTITION BY q ORDER BY rank), first_value(y) {whole}) AS y2
FROM ({nn}) nn"""


def _rings(edges: str) -> str:
    return f"""
SELECT q AS window_id,
       list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY seq) AS edges,
       min(x1) AS mnx, max(x1) AS mxx, min(y1) AS mny, max(y1) AS mxy
FROM ({edges}) e GROUP BY q HAVING count(*) >= 3"""


_CROSS = "((e.x1 - x) * (e.y2 - y) - (e.x2 - x) * (e.y1 - y))"
_ODD = (f"(list_sum(list_transform(edges, lambda e: CASE WHEN ((e.y1 > y) <> (e.y2 > y)) "
        f"AND (({_CROSS} > 0) = (e.y2 > e.y1)) THEN 1 ELSE 0 END)) % 2 = 1)")
_TOUCH = (f"list_bool_or(list_transform(edges, lambda e: {_CROSS} = 0 "
          f"AND x >= least(e.x1, e.x2) AND x <= greatest(e.x1, e.x2) "
          f"AND y >= least(e.y1, e.y2) AND y <= greatest(e.y1, e.y2)))")
_PIP = {"intersects": f"({_ODD} OR {_TOUCH})", "covers": f"({_ODD} OR {_TOUCH})",
        "interior": f"({_ODD} AND NOT {_TOUCH})"}


def _pip_join(points: str, rings: str, predicate: str) -> str:
    return f"""
SELECT window_id, id, x, y FROM ({points}) p JOIN ({rings}) r
  ON x >= mnx AND x <= mxx AND y >= mny AND y <= mxy
WHERE {_PIP[predicate]}"""


def _summary(matches: str) -> str:
    return f"""
SELECT window_id, count(*) AS n_matches, count(DISTINCT id) AS n_ids,
       min(id) AS min_id, max(id) AS max_id
FROM ({matches}) m GROUP BY window_id"""


# --- quad-tree -------------------------------------------------------------------

def _interleaved(gx: str, gy: str, depth: int) -> str:
    """Bits of two cell numbers in turn, bit by bit."""
    return (f"CAST(list_sum(list_transform(range(0, {depth}), lambda b: "
            f"((({gx}) // pow(2, b)::BIGINT) % 2) * pow(4, b)::BIGINT + ((({gy}) // pow(2, b)::BIGINT) % 2) * 2 * pow(4, b)::BIGINT)) AS BIGINT)")


def _grid(v: str, lo: str, hi: str, depth: int) -> str:
    side = 1 << depth
    return (f"least(CAST({side - 1} AS BIGINT), greatest(CAST(0 AS BIGINT), coalesce("
            f"CAST(floor(({v} - {lo}) / nullif({hi} - {lo}, 0) * {lit(side)}) AS BIGINT), 0)))")


def _coded(points: str, depth: int) -> str:
    gx = _grid("x", "gminx", "gmaxx", depth)
    gy = _grid("y", "gminy", "gmaxy", depth)
    return f"""
SELECT id, x, y, {_interleaved('gx', 'gy', depth)} AS code FROM (
  SELECT p.*, {gx} AS gx, {gy} AS gy
  FROM ({points}) p CROSS JOIN (SELECT min(x) AS gminx, max(x) AS gmaxx, min(y) AS gminy,
                                       max(y) AS gmaxy FROM ({points}) e) g) t"""


def _leaves(points: str, depth: int, cap: int) -> str:
    return f"""
WITH codes AS (
  SELECT code, count(*) AS n, min(x) AS lminx, max(x) AS lmaxx, min(y) AS lminy, max(y) AS lmaxy
  FROM ({_coded(points, depth)}) c GROUP BY code),
nodes AS (
  SELECT d.range AS depth, code >> CAST(2 * ({depth} - d.range) AS INTEGER) AS prefix,
         CAST(sum(n) AS BIGINT) AS n, min(lminx) AS lminx, max(lmaxx) AS lmaxx,
         min(lminy) AS lminy, max(lmaxy) AS lmaxy
  FROM codes CROSS JOIN range(0, {depth + 1}) d GROUP BY 1, 2)
SELECT CAST(c.depth AS INTEGER) AS depth, c.prefix, c.n, c.lminx, c.lmaxx, c.lminy, c.lmaxy
FROM nodes c LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = (c.prefix >> 2)
WHERE (c.n <= {cap} OR c.depth = {depth}) AND (c.depth = 0 OR p.n > {cap})"""


def _assign(points: str, depth: int, cap: int) -> str:
    return f"""
SELECT p.id, p.x, p.y, l.depth, l.prefix
FROM ({_coded(points, depth)}) p JOIN ({_leaves(points, depth, cap)}) l
  ON l.prefix = (p.code >> CAST(2 * ({depth} - l.depth) AS INTEGER))"""


def _windows_to_leaves(windows: str, leaves: str) -> str:
    return f"""
SELECT window_id, depth, prefix FROM ({windows}) w JOIN ({leaves}) l
  ON mnx <= lmaxx AND mxx >= lminx AND mny <= lmaxy AND mxy >= lminy"""


def oracle_sql() -> dict[str, str]:
    rw = C.query_window_value(*C.RANGE_WINDOW)
    kp = C.query_point_value(*C.KNN_POINT)
    windows = _windows(C.N_WINDOWS, C.WINDOW_SEED)
    queries = _query_points(C.N_QUERIES, C.QUERY_SEED)
    seeds = _query_points(C.N_SEEDS, C.SEEDS_SEED)
    seed = _seed_table(*C.SEED_POINT)
    carried = f"SELECT id, x, y, id % 7 AS depth, id % 5 AS rank, x * 2 AS mnx FROM ({POINTS_B})"
    in_rw = (f"x >= {lit(rw[0])} AND x <= {lit(rw[1])} AND y >= {lit(rw[2])} AND y <= {lit(rw[3])}")
    range_pairs = f"""
SELECT window_id, id, x, y FROM ({POINTS_B}) p JOIN ({windows}) w
  ON x >= mnx AND x <= mxx AND y >= mny AND y <= mxy"""
    range_count = f"""
SELECT w.window_id, CAST(count(p.window_id) AS BIGINT) AS n FROM ({windows}) w
LEFT JOIN ({range_pairs}) p ON p.window_id = w.window_id GROUP BY w.window_id"""
    knn_single = f"SELECT rank, id, x, y, d2 FROM ({_knn_rows(POINTS_A, _seed_table(*kp), C.K_KNN)})"
    knn_many = _knn_rows(POINTS_A, queries, C.K_KNN)
    seed_rings = _rings(_ring_edges(_knn_rows(POINTS_A, seeds, C.K_RING)))
    one_ring = _rings(_ring_edges(_knn_rows(POINTS_A, seed, C.K_RING)))
    pip_c = _pip_join(POINTS_B, seed_rings, "intersects")
    knn_join = _pip_join(POINTS_B, one_ring, "intersects")
    leaves_d = _leaves(POINTS_D, C.QT_DEPTH, C.QT_CAP)
    d_pairs = f"""
SELECT window_id, id, x, y FROM ({POINTS_D}) p JOIN ({windows}) w
  ON x >= mnx AND x <= mxx AND y >= mny AND y <= mxy"""
    customers = _points_for("customer", "c_custkey", C.CUSTOMER_SEED)
    count_windows = _windows_for("customer", "c_custkey", C.CUSTOMER_SEED, C.COUNT_SHARE)
    pair_windows = _windows_for("customer", "c_custkey", C.CUSTOMER_SEED, C.PAIR_SHARE)
    in_box = "x >= mnx AND x <= mxx AND y >= mny AND y <= mxy"
    return {
        "random_points": customers,
        "random_windows": _windows_for("customer", "c_custkey", C.CUSTOMER_SEED, 1.0),
        "knn_batch_indexed_many": _knn_rows(POINTS_A, customers, C.K_MANY),
        "range_counts_pyramid": f"""SELECT w.window_id, CAST(count(p.id) AS BIGINT) AS n FROM ({count_windows}) w
                                    LEFT JOIN ({POINTS_D}) p ON {in_box} GROUP BY w.window_id""",
        "range_pairs_indexed_many": f"SELECT window_id, id, x, y FROM ({POINTS_B}) p JOIN ({pair_windows}) w ON {in_box}",
        "pip_join_copartitioned": _pip_join(POINTS_B, seed_rings, "covers"),
        "range_pairs_copartitioned": d_pairs,
        "points_documents": POINTS_B,
        "range_window_documents": f"SELECT id, x, y FROM ({POINTS_B}) WHERE {in_rw}",
        "pip_join_many_edges": _many_edges(POINTS_A, _horizon()),
        "pip_join_grouped_bitmap": _summary(pip_c),
        "persisted_reuse": f"""SELECT 'range' AS query, window_id AS k, n FROM ({range_count})
                               UNION ALL SELECT 'window', 0::BIGINT, count(*) FROM ({POINTS_B}) WHERE {in_rw}
                               UNION ALL SELECT 'all', 0::BIGINT, count(*) FROM ({POINTS_B})""",
        "stream_knn": _knn_rows(POINTS_A, queries, C.K_RING),
        "extent_count": f"""SELECT min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy,
                             count(*) AS n FROM ({POINTS_B})""",
        "points_sql_projection": POINTS_B,
        "points_from_csv": POINTS_B,
        "points_from_json": POINTS_B,
        "points_from_csv_carried": carried,
        "range_window": f"SELECT id, x, y FROM ({POINTS_B}) WHERE {in_rw}",
        "range_window_clustered": f"SELECT id, x, y FROM ({POINTS_B}) WHERE {in_rw}",
        "range_batch_count": range_count,
        "range_batch_count_cells": range_count,
        "range_pairs_cells": d_pairs,
        "range_pairs_dup_windows": f"SELECT * FROM ({d_pairs}) UNION ALL SELECT * FROM ({d_pairs}) "
                                   f"UNION ALL SELECT NULL::BIGINT AS window_id, id, x, y FROM ({d_pairs})",
        "knn_point": knn_single,
        "knn_point_cells": knn_single,
        "knn_batch": knn_many,
        "knn_batch_cells": knn_many,
        "knn_ring": _ring_edges(_knn_rows(POINTS_A, seed, C.K_RING)),
        "pip_join_intersects": pip_c,
        "pip_join_covers_cells": _pip_join(POINTS_B, seed_rings, "covers"),
        "pip_join_foreign_tree": _pip_join(POINTS_B, seed_rings, "covers"),
        "pip_join_carried": f"SELECT window_id, id, x, y, id % 7 AS depth, id % 5 AS rank, x * 2 AS mnx FROM ({_pip_join(POINTS_B, seed_rings, 'covers')})",
        "pip_join_interior": _pip_join(POINTS_B, seed_rings, "interior"),
        "pip_join_grouped": _summary(pip_c),
        "matched_window_count": f"SELECT count(DISTINCT window_id) AS n_windows FROM ({pip_c})",
        "pip_join_grouped_pairs": f"SELECT DISTINCT window_id, id FROM ({pip_c})",
        "range_window_count": f"SELECT count(*) AS n FROM ({POINTS_B}) WHERE {in_rw}",
        "knn_point_count": f"SELECT count(*) AS n FROM ({knn_single})",
        "knn_join": knn_join,
        "knn_join_cells": knn_join,
        "knn_join_batch": _summary(_pip_join(POINTS_C, seed_rings, "intersects")),
        "knn_join_batch_indexed": _summary(_pip_join(POINTS_C, seed_rings, "intersects")),
        "quadtree_leaves": leaves_d,
        "quadtree_assign": _assign(POINTS_D, C.QT_DEPTH, C.QT_CAP),
        "windows_to_leaves": _windows_to_leaves(windows, leaves_d),
        "range_window_indexed": f"SELECT id, x, y FROM ({POINTS_B}) WHERE {in_rw}",
        "range_batch_count_indexed": range_count,
        "knn_point_indexed": knn_single,
        "knn_batch_indexed": knn_many,
        "pip_join_indexed": _pip_join(POINTS_B, seed_rings, "covers"),
        "knn_join_indexed": knn_join,
        "pip_join_covers_partitioned": _pip_join(POINTS_B, seed_rings, "covers"),
        "knn_join_partitioned": knn_join,
        "range_pairs_partitioned": d_pairs,
        "stream_range_window": f"SELECT id, x, y FROM ({POINTS_B}) WHERE {in_rw}",
        "stream_pip_join": pip_c,
    }


__all__ = ["oracle_sql", "lit"]
