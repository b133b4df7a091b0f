"""Operators of a training-data pipeline: one module each, and the queries that apply them to whole tables."""

import sys

from pyspark import cloudpickle

# Worker functions travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
