"""Spark-native analytics for three-outcome pari-mutuel pool coupons.

Every public function takes DataFrames and returns a DataFrame. Nothing runs
until the caller asks for an action, except where a docstring says so.
"""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors by value, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
