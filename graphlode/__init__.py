"""Spark-native analytics over a code and document corpus.

Everything is an ordinary DataFrame: documents and postings, a typed property
graph, commit history, vectors and event logs.  Functions that run in Python
workers are shipped by value, so executors need no installation of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
