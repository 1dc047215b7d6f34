"""Time-split regression over multi-year survey tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
