"""Survey-panel analytics on Spark: entity x year x amount, for all entities at once."""

import sys

from pyspark import cloudpickle

# Ship the functions that run in tasks by value: executors need numpy and
# pandas, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
