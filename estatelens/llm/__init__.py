"""Operators of a training-data pipeline: deduplication, sharding, archives, tokens, language, leaks, search.

Functions that run on executors are pickled by value, so a cluster needs numpy,
pyarrow and the third-party tokenizers library, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
