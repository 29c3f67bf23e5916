"""Automated analysis of tables on Spark: profile, clean, describe, diagnose, predict, prescribe."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python helpers travel with their jobs, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
