"""Document retrieval and evaluation analytics as set-at-a-time Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in the tasks travel with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
