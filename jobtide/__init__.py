"""Background-job lifecycle processing as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Functions and state processors of this package travel to the workers by value, so executors need not
# have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
