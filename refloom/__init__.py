"""Cross-reference and corpus analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python code of the plans travels with them, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
