"""Operators of a training-data pipeline. Their code travels with the tasks, so executors need no installed copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
