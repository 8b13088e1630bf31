"""quire: document analytics on Spark.

Functions that run inside Python workers are pickled by value, so a worker
needs numpy and pyarrow but not this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
