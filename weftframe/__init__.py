"""weftframe: table and stream transformations as composed Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the task that needs
# them, so it does not have to be installed there or sent as a file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
