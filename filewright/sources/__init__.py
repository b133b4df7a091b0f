"""Inputs: inventories, text previews, logs."""

from pyspark import cloudpickle

from filewright.sources import files

# What lists and reads files in workers travels with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(files)
