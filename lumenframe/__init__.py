"""lumenframe: sensor-image and log analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
