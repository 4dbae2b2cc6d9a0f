"""Operators for preparing training data (see ``queries.py`` for the
registered ones).  Nothing outside this package imports it.

Worker-side functions are pickled by value, so executors need no installed
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
