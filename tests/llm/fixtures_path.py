"""Gives the fixtures under one short name, however the tests are started."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import fixtures as fx  # noqa: E402, F401
