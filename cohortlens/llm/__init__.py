"""Operators for building training data from document tables, and their registered queries."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need numpy, pyarrow and the codecs but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
