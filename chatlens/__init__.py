"""Customer-service chat log analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# What runs in Python workers is shipped with the job, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
