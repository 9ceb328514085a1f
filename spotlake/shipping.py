"""Functions that run on executors without the library installed there."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Send the functions of `module` to Python workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
