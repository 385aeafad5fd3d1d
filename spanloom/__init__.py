"""spanloom: package-search and graph analytics as Spark DataFrame operators.

Functions of this package that run in Python workers are pickled by value, so
executors need Spark, numpy, pandas and pyarrow but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
