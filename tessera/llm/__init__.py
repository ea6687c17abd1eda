"""Training-data operators: dedup, filtering, mixing, decontamination and token output.

Kernels run on executors that may not have this package on their path, so functions of
this subpackage travel with their tasks by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
