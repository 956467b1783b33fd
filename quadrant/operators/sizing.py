"""Size checks that gate every broadcast.

A side is broadcast only when its row count is proven small: either bounded by
the call's own parameters (``known_rows``) or measured.  The measurement reads
at most ``max_rows + 1`` rows per partition (``limit`` + ``count``), so it is
cheap even when the answer is "too big".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default row bound for broadcasting a small side (windows, rings, leaves, cells).
MAX_BROADCAST_ROWS = 200_000
# A nested-loop join tests every point against every broadcast row, so its cost
# is points x rows: beyond this many windows / queries, ``auto`` strategies use
# an equi-join on cells instead, where each point only meets its own cell's rows.
MAX_LOOP_ROWS = 256


def rows_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                    known_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast-hint ``df`` if its size is proven within ``max_rows``.

    Returns the (possibly hinted) frame and whether it was hinted, so the
    caller can pick a shuffle-based plan otherwise.  ``known_rows`` may only come from a count or
    from a table's own definition; what callers merely state is measured.
    """
    small = known_rows <= max_rows if known_rows is not None else rows_at_most(df, max_rows)
    return (F.broadcast(df), True) if small else (df, False)


def small_or_shuffled(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, known_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Like ``maybe_broadcast``, but a table that is not proven small is never broadcast.

    Without the hint Spark would go by the size of compressed files, where millions of
    cells take less than its threshold, and the driver would have to hold them.
    """
    df, small = maybe_broadcast(df, max_rows, known_rows)
    return (df, True) if small else (df.hint("merge"), False)


# Default bound on the total number of polygon edges in a broadcast window table.
MAX_BROADCAST_EDGES = 5_000_000


def maybe_broadcast_polygons(windows: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                             max_edges: int = MAX_BROADCAST_EDGES,
                             known_rows: int | None = None,
                             known_edges_per_row: int | None = None) -> tuple[DataFrame, bool]:
    """Like ``maybe_broadcast`` for polygon windows, also bounding the edges.

    A window's size is its edge array, so the row count alone proves nothing.
    With both bounds known from the caller's parameters (e.g. rings of k
    edges per seed) no job runs; otherwise one aggregate reads at most
    ``max_rows + 1`` rows.
    """
    if known_rows is not None and known_edges_per_row is not None:
        small = known_rows <= max_rows and known_rows * known_edges_per_row <= max_edges
    else:
        r = windows.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"),
                                            F.sum(F.size("edges")).alias("e")).first()
        small = r["n"] <= max_rows and (r["e"] or 0) <= max_edges
    return (F.broadcast(windows), True) if small else (windows, False)


def shielded(pts: DataFrame, taken: list[str]) -> tuple[DataFrame, list]:
    """Points with their carried columns under names no operator uses, and the columns that give them back.

    ``taken`` are the names the result adds; a carried column of such a name can't be returned.
    """
    carried = [c for c in pts.columns if c not in ("id", "x", "y")]
    if clash := [c for c in carried if c in taken]:
        raise ValueError(f"rename the carried columns {clash}: the result has columns of that name")
    inner = {c: f"_carried_{i}" for i, c in enumerate(carried)}
    back = [F.col(inner[c]).alias(c) if c in inner else F.col(c) for c in pts.columns]
    return pts.select(*(F.col(f"`{c}`").alias(inner.get(c, c)) for c in pts.columns)), back


__all__ = ["shielded", "MAX_BROADCAST_ROWS", "MAX_LOOP_ROWS", "MAX_BROADCAST_EDGES", "rows_at_most", "maybe_broadcast", "small_or_shuffled",
           "maybe_broadcast_polygons"]
