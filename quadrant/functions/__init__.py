from quadrant.functions.geometry import *  # noqa: F401,F403
from quadrant.functions.generators import *  # noqa: F401,F403
