"""Training-data operators: quality, language, deduplication, scoring, tokens and packing.

Functions of this package that run in tasks are sent by value, so Python
workers need only the third-party libraries, not this repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
