"""Inventory, preparation and measurement of large mixed-media collections on Spark."""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks travel with the job, so executors need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
