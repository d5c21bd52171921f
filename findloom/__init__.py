"""findloom: multilingual full-text search, search analytics and corpus preparation as Spark jobs.

Functions that run in Python workers are pickled by value, so executors need
only PySpark, pyarrow, pandas and numpy, not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
