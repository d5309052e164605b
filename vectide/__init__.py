"""Embedding-store analytics on Spark: similarity search, store upkeep, access statistics,
metrics, clustering, precompute models and their streaming twins.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
