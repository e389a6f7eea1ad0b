"""A property-graph analytics engine on Spark DataFrames."""

import importlib

from pyspark import cloudpickle

# Functions of these parts are sent to executors by value, so workers need not have the package.
for _part in ("graphspark.functions", "graphspark.operators"):
    cloudpickle.register_pickle_by_value(importlib.import_module(_part))
