"""Adaptive quad-tree cells (L1-L3): the spatial partitioning of a point set.

Leaves are computed exactly, with aggregations only:

1. every point gets a Morton code on a 2^D x 2^D grid over the extent;
2. points are counted per code (map-side partial aggregation, so a hot code
   costs one row per task, not one row per point);
3. the code counts are rolled up to every depth 0..D (explode + group);
4. a node is a leaf when it is small enough (``n <= cap`` or at depth D) and
   its parent was split (``parent n > cap``).  A parent's count is the sum of
   its (at most four) children's counts, so it comes from a window over
   siblings, not from a second pass over the nodes.

Leaves tile the occupied space, so every point falls in exactly one leaf.
The number of leaves is bounded by ``1 + 3 * D * ceil(n / cap)`` and by 4^D;
``target_leaves`` makes ``cap`` grow with the data so the leaf table (and its
broadcast) stays the same size at any scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrant.functions.geometry import grid_coord, morton_prefix, with_morton
from quadrant.operators.sizing import MAX_BROADCAST_ROWS, maybe_broadcast
from quadrant.session import materialize as write_table

LEAF_KEY = ["depth", "prefix"]
_GRID = ["gminx", "gmaxx", "gminy", "gmaxy"]


@dataclass
class QuadTree:
    """Leaves plus the one-row grid description needed to place points.

    ``leaves``: ``(depth INT, prefix BIGINT, n BIGINT, lminx, lmaxx, lminy, lmaxy)``
    with the actual bounds of the points in each leaf.
    ``grid``: one row ``(gminx, gmaxx, gminy, gmaxy, dmin, dmax)``.
    ``n_leaves``: known once the tree is materialised, else None.
    """

    leaves: DataFrame
    grid: DataFrame
    max_depth: int
    n_leaves: int | None = None
    # When small enough: every cell at depth ``cell_depth`` (the deepest leaf
    # depth) mapped to its leaf, so placing a point is one hash probe.
    cells: DataFrame | None = None
    cell_depth: int | None = None
    # Grid bounds as Python floats once materialised (used as literals).
    bounds: tuple[float, float, float, float] | None = None
    # (depth, prefix) of all leaves, the empty ones included: they tile the whole grid.
    tiles: DataFrame | None = None


def _coded(pts: DataFrame, ext: DataFrame | tuple, max_depth: int) -> DataFrame:
    """Attach the depth-D Morton code ``_code``.

    ``ext`` is either the grid bounds as floats (literals, folded into the
    generated code) or, before they are known, a one-row frame attached by
    a broadcast.
    """
    if isinstance(ext, tuple):
        mnx, mxx, mny, mxy = (F.lit(float(v)) for v in ext)
        gx = grid_coord("x", mnx, mxx, max_depth)
        gy = grid_coord("y", mny, mxy, max_depth)
        return with_morton(pts, gx, gy, "_code")
    g = pts.crossJoin(F.broadcast(ext.select(*_GRID)))
    gx = grid_coord("x", F.col("gminx"), F.col("gmaxx"), max_depth)
    gy = grid_coord("y", F.col("gminy"), F.col("gmaxy"), max_depth)
    return with_morton(g, gx, gy, "_code").drop(*_GRID)


def _extent_row(pts: DataFrame, extent) -> DataFrame:
    stats = pts.agg(F.min("x").alias("gminx"), F.max("x").alias("gmaxx"),
                    F.min("y").alias("gminy"), F.max("y").alias("gmaxy"),
                    F.count(F.lit(1)).alias("n"))
    if extent is None:
        return stats
    mnx, mxx, mny, mxy = (float(v) for v in extent)
    return stats.select(F.lit(mnx).alias("gminx"), F.lit(mxx).alias("gmaxx"),
                        F.lit(mny).alias("gminy"), F.lit(mxy).alias("gmaxy"), "n")


def _leaves(pts: DataFrame, ext: DataFrame, max_depth: int, cap, target_leaves,
            bounds: tuple | None = None) -> DataFrame:
    coded = _coded(pts.select("x", "y"), bounds or ext, max_depth)
    codes = coded.groupBy("_code").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lminx"), F.max("x").alias("lmaxx"),
        F.min("y").alias("lminy"), F.max("y").alias("lmaxy"))
    nodes = (codes
             .withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
             .withColumn("prefix", morton_prefix("_code", F.col("depth"), max_depth))
             .groupBy("depth", "prefix")
             .agg(F.sum("n").alias("n"), F.min("lminx").alias("lminx"), F.max("lmaxx").alias("lmaxx"),
                  F.min("lminy").alias("lminy"), F.max("lmaxy").alias("lmaxy")))
    siblings = Window.partitionBy("depth", F.shiftright(F.col("prefix"), 2))
    nodes = nodes.withColumn("_pn", F.sum("n").over(siblings))
    if cap is not None:
        cap_col = F.lit(int(cap)).cast("bigint")
    else:
        cap_row = ext.select(F.greatest(F.lit(1).cast("bigint"),
                                        F.ceil(F.col("n") / F.lit(float(target_leaves))).cast("bigint"))
                             .alias("_cap"))
        nodes = nodes.crossJoin(F.broadcast(cap_row))
        cap_col = F.col("_cap")
    return (nodes
            .where(((F.col("n") <= cap_col) | (F.col("depth") == max_depth))
                   & ((F.col("depth") == 0) | (F.col("_pn") > cap_col)))
            .select(F.col("depth").cast("int").alias("depth"), "prefix", "n",
                    "lminx", "lmaxx", "lminy", "lmaxy"))


def _grid(ext: DataFrame, leaves: DataFrame) -> DataFrame:
    depths = leaves.agg(F.min("depth").alias("dmin"), F.max("depth").alias("dmax"))
    return ext.select(*_GRID).crossJoin(depths)


def quadtree(pts: DataFrame, max_depth: int = 12, cap: int | None = None,
             target_leaves: int | None = None,
             extent: tuple[float, float, float, float] | None = None,
             materialize: bool = True) -> QuadTree:
    """L2: adaptive quad-tree leaves of a point set.

    Give ``cap`` (points per leaf) or ``target_leaves`` (cap = ceil(n / target),
    the scale-free choice; default 1024).  ``extent`` fixes the grid; by
    default it is the data's own extent (L1).

    ``materialize`` (default) writes the extent row, then the leaves, as
    Parquet in the shared checkpoint folder, in that order, so each is
    computed once, later jobs read them back, and lost executors never force
    a recount of the points.
    """
    if not 0 <= max_depth <= 30:
        raise ValueError("max_depth must be within 0..30")
    if cap is not None and target_leaves is not None:
        raise ValueError("give at most one of cap and target_leaves")
    if cap is None and target_leaves is None:
        target_leaves = 1024
    ext = _extent_row(pts, extent)
    bounds = None
    if materialize:
        ext = write_table(ext, "quadtree-extent")
        r = ext.first()
        if r["gminx"] is not None:
            bounds = (r["gminx"], r["gmaxx"], r["gminy"], r["gmaxy"])
    leaves = _leaves(pts, ext, max_depth, cap, target_leaves, bounds)
    tiles = _tiles(leaves)
    n_leaves = None
    cells = cell_depth = None
    if materialize:
        leaves = write_table(leaves, "quadtree-leaves")
        tiles = write_table(_tiles(leaves), "quadtree-tiles")
        n_leaves = leaves.count()
        hist = {r["depth"]: r["count"] for r in tiles.groupBy("depth").count().collect()}
        dmax = max(hist)
        # Cells at depth dmax covered by the tiles: known before building them.
        if sum(c * 4 ** (dmax - d) for d, c in hist.items()) <= MAX_BROADCAST_ROWS:
            shift = ((F.lit(dmax) - F.col("depth")) * 2).cast("int")
            lo = F.call_function("shiftleft", F.col("prefix"), shift)
            hi = F.call_function("shiftleft", F.col("prefix") + 1, shift) - 1
            cells = write_table(tiles.select("depth", "prefix", F.explode(F.sequence(lo, hi)).alias("_cell")),
                                "quadtree-cells")
            cell_depth = dmax
    return QuadTree(leaves, _grid(ext, leaves), max_depth, n_leaves, cells, cell_depth, bounds, tiles)


def _tiles(leaves: DataFrame) -> DataFrame:
    """``(depth, prefix)`` of the leaves plus the empty ones beside them.

    Every node above a leaf is split, and a child of a split node that is neither
    split nor a leaf is an empty leaf.  Together they tile the grid, so any point, also one
    of another set, has exactly one tile.
    """
    spark = leaves.sparkSession
    own = leaves.select("depth", "prefix")
    split = (own.where(F.col("depth") > 0)
             .select(F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("d"), "depth", "prefix")
             .select(F.col("d").alias("depth"), F.call_function("shiftright", F.col("prefix"), ((F.col("depth") - F.col("d")) * 2).cast("int")).alias("prefix"))
             .distinct())
    root = spark.range(1).select(F.lit(0).alias("depth"), F.col("id").alias("prefix"))
    children = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("c"), "prefix").select(
        "depth", (F.col("prefix") * 4 + F.col("c")).cast("bigint").alias("prefix"))
    empty = root.unionByName(children).join(own.unionByName(split), LEAF_KEY, "left_anti")
    return own.unionByName(empty)


def assign_leaves(pts: DataFrame, qt: QuadTree, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Tag each point with its leaf ``(depth, prefix)``.

    With a materialised tree whose tiles, expanded to cells at the deepest
    depth, fit the broadcast bound, a point's cell at that depth names
    its tile: one hash probe.  Otherwise a point's candidate nodes are its
    code's prefixes at every depth, and exactly one of them is a tile: an equi-join on
    the leaf key.  Points of another set than the tree's take part too: they may fall in
    empty tiles, and points outside the grid belong to its border.
    """
    coded = _coded(pts, qt.bounds or qt.grid, qt.max_depth)
    if qt.cells is not None:
        # One probe per point: its cell at the deepest depth names its tile.
        cell = F.shiftright(F.col("_code"), 2 * (qt.max_depth - qt.cell_depth))
        return (coded.withColumn("_cell", cell)
                .join(F.broadcast(qt.cells), "_cell", "inner").drop("_cell", "_code"))
    exploded = (coded.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(qt.max_depth))))
                .withColumn("prefix", morton_prefix("_code", F.col("depth"), qt.max_depth))
                .drop("_code"))
    tiles, _ = maybe_broadcast(qt.tiles, max_broadcast_rows)
    return exploded.join(tiles, LEAF_KEY, "inner")


def pair_windows(windows: DataFrame, qt: QuadTree) -> DataFrame:
    """All columns of ``windows`` (with mnx, mxx, mny, mxy) and ``(depth, prefix)`` of each tile its box may meet.

    Window rows are carried along, so ids may repeat or be NULL.  The box is compared in cells of
    the tree's grid, with the very function that places points, so a point inside the box lies in
    one of its tiles whichever set it belongs to.  A box is covered by a few cells of about its own size; a tile
    meets it if it is one of them, lies above one or lies inside one: equi-joins only.
    A box with a NULL or NaN bound meets nothing.
    """
    D = qt.max_depth
    mnx, mxx, mny, mxy = ((F.lit(float(v)) for v in qt.bounds) if qt.bounds else map(F.col, _GRID))
    w = windows if qt.bounds else windows.crossJoin(F.broadcast(qt.grid.select(*_GRID)))
    w = w.where((F.col("mnx") <= F.col("mxx")) & (F.col("mny") <= F.col("mxy")))
    for name, v, lo, hi in (("_x0", "mnx", mnx, mxx), ("_x1", "mxx", mnx, mxx), ("_y0", "mny", mny, mxy), ("_y1", "mxy", mny, mxy)):
        w = w.withColumn(name, grid_coord(v, lo, hi, D))
    span = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    w = w.withColumn("_s", F.least(F.lit(D), F.ceil(F.log2((span + 1) / F.lit(2.0)))).cast("int"))
    w = w.withColumn("_s", F.greatest(F.lit(0), F.col("_s")))
    down = lambda c, s: F.call_function("shiftright", F.col(c), s)
    up = lambda c, s: F.call_function("shiftleft", c, s)
    for c in ("_x0", "_x1", "_y0", "_y1"):
        w = w.withColumn(c, down(c, F.col("_s")))
    cells = w.withColumn("_cx", F.explode(F.sequence("_x0", "_x1")))
    cells = cells.withColumn("_cy", F.explode(F.sequence("_y0", "_y1"))).withColumn("_kx", F.col("_cx")).withColumn("_ky", F.col("_cy"))
    cells = with_morton(cells, "_kx", "_ky", "_cell").withColumn("_depth", F.lit(D) - F.col("_s"))
    above = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.col("_depth")))).withColumn("_t", F.col("_depth") - F.col("depth"))
    # Of a window's cells below one tile only the first brings the pair.
    first = ((F.col("_cx") == F.greatest(F.col("_x0"), up(down("_cx", F.col("_t")), F.col("_t"))))
             & (F.col("_cy") == F.greatest(F.col("_y0"), up(down("_cy", F.col("_t")), F.col("_t")))))
    above = above.where(first).withColumn("prefix", down("_cell", (F.col("_t") * 2).cast("int")))
    met_above = above.join(qt.tiles, LEAF_KEY).select(*windows.columns, *LEAF_KEY)
    inside = (qt.tiles.where(F.col("depth") > 0).withColumn("_depth", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
              .withColumn("_cell", down("prefix", ((F.col("depth") - F.col("_depth")) * 2).cast("int"))))
    met_inside = cells.join(inside, ["_depth", "_cell"]).select(*windows.columns, *LEAF_KEY)
    return met_above.unionByName(met_inside)


def windows_to_leaves(windows: DataFrame, qt: QuadTree) -> DataFrame:
    """L3: ``(window_id, depth, prefix)`` for every leaf whose point bounds meet the window box.

    Uses each occupied leaf's actual min/max of x and y (tighter than its grid square), so it
    speaks of the tree's own points; joins of any points use ``pair_windows``.
    """
    w = windows.select("window_id", "mnx", "mxx", "mny", "mxy")
    leaves = qt.leaves.select(*LEAF_KEY, "lminx", "lmaxx", "lminy", "lmaxy")
    cond = ((F.col("mnx") <= F.col("lmaxx")) & (F.col("mxx") >= F.col("lminx"))
            & (F.col("mny") <= F.col("lmaxy")) & (F.col("mxy") >= F.col("lminy")))
    return pair_windows(w, qt).join(leaves, LEAF_KEY).where(cond).select("window_id", *LEAF_KEY)


__all__ = ["QuadTree", "quadtree", "assign_leaves", "pair_windows", "windows_to_leaves", "LEAF_KEY"]
