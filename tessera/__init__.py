"""Tessera: a Spark-first analytics engine (frames, expressions, SQL, files, streams).

Functions that go to Python workers travel by value: executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
