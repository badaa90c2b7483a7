"""docloom: document analytics expressed as Spark plans.

Functions that run inside Python workers are shipped by value, so that executors
need nothing but Python, pyarrow, numpy and pandas on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
