"""Feature sets, stages, candidate grids, tree models and experiments."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
