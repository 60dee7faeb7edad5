"""Operators for preparing training text: quality, duplicates, language, mixing, sharding."""

import sys

from pyspark import cloudpickle

# Code that runs in tasks travels with the job instead of being installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
