from quadrant.sources.points import points, read_points, points_sql, extent, valid_xy  # noqa: F401
from quadrant.sources.derived import points_a, points_b, points_c, points_d  # noqa: F401
