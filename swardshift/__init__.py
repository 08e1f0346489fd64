"""Survey compilation and model-transfer analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .session import build_session, cut_lineage

# Functions of this package travel to the executors by value, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut_lineage"]
