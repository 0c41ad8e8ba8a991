"""Offer-to-catalog matching on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
