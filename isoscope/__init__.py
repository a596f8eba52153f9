"""isoscope: Spark table operators for differential alternative-splicing results.

Every public operator takes DataFrames (or Columns) and returns a DataFrame (or
a Column).  Nothing here owns a session: pass one in.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so workers need no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
