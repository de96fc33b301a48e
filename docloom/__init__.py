"""Document preparation and answer evaluation as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to the executors with their code, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
