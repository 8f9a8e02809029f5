"""Spark-native operators for sensor, signal, image-vector and document analytics."""
import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
