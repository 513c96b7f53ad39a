"""Spark jobs over knowledge-base entries, account tables and activity logs.

The kernels that run inside Python workers travel with the job, so the package
need not be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
