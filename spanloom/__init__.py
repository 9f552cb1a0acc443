"""Spanloom: transcript, interval and corpus analytics declared as Spark plans.

The package is shipped to the Python workers by value, so that a cluster
needs no installed copy of it: only its dependencies.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
