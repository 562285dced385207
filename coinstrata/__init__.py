"""Ledger analytics and data processing on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
