"""Spark-native analytics for judging structured drawings at table scale."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with them: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
