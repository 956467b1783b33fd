import os
import sys

sys.path.append(os.path.dirname(os.path.abspath(__file__)))
