from quadrant.streaming.points import (  # noqa: F401
    read_points_stream, table_stream, stream_range, stream_pip_join, run_available,
)
