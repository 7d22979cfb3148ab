"""Spark-native auditing of packages, their files, locks, reports and documents."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
