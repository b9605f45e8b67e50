"""Training-data operators (licence scan, dedup, quality, language, toxicity, decontamination, mixing).

Self-contained: nothing else in the library imports this subpackage. Every
operator takes DataFrames and column names and returns a DataFrame; the thin
registered queries are in ``registry.py``.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel by value with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
