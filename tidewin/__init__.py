"""Analytics for windowed sensor data and detector scores, on PySpark DataFrames."""
import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: they needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
