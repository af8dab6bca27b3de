"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: tasks bring the functions of its modules along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
