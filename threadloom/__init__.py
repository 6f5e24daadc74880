"""Chat-corpus ETL, conversational windows and vector retrieval on Spark DataFrames.

Functions that run in Python workers travel by value, so executors need
numpy / pandas / pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
