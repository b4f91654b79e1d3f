"""Operators for preparing training data, one module each; ``queries`` registers them."""

import sys

from pyspark import cloudpickle

# Functions of these modules run in workers that may lack the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
