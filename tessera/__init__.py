"""Flow, box, document and evaluation analytics as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
