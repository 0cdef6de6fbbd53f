"""Space-time panel analytics on PySpark: operators, sources, functions, plans and streams."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers with what they use: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
