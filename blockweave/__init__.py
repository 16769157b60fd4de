"""Matrix algebra, non-negative factorisation and a neural classifier as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with the job, so executors need no
# separate install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
