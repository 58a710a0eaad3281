"""Spark jobs that turn public meeting minutes into tables and report over them."""

import sys

from pyspark import cloudpickle

# Functions that run on Arrow batches travel with the job, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
