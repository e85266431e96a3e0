"""quire: document collections as Spark DataFrames.

Chunking, keyword / vector / hybrid search, content selection, similarity
graphs, persona ranking, context packing, outline extraction, evaluation and
table upkeep, all as DataFrame jobs.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Tasks carry the package's small helpers by value, so executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
