"""Property-graph queries and benchmark analytics as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
