"""Operators of a training-data pipeline over documents, conversations and web pages.

Nothing outside this folder imports it. Functions that run inside Python workers are pickled by
value, so executors need no copy of the library.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
