"""Source-corpus analytics on Spark: files, findings, scores, chunks and reports as DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions travel inside their job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
