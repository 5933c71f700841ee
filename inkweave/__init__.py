"""Spark-native engine for figure-preserving office-document analytics."""

from __future__ import annotations

import os
from pathlib import Path

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Make Python workers independent of the driver's ``sys.path``.

    Kernels are pickled by reference where workers can import this package
    (its parent is on PYTHONPATH or is the working directory), by value
    elsewhere, so that nothing has to be copied to the executors.
    """
    root = str(Path(__file__).resolve().parent.parent)
    reachable = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if root not in (os.path.realpath(p) for p in reachable if p):
        import sys

        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
