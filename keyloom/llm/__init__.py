"""Training-data operators: mixing, deduplication, filtering, classification and tokenisation.

Nothing else in the library imports this subpackage. Each module holds one operator with a general
interface and the thin ``opN_*`` query that applies it to the tables of a data folder.
"""

import sys

from pyspark import cloudpickle

# what runs in Python workers is sent to them whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
