"""fieldloom: extraction-quality analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
