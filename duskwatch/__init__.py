"""Security-event analytics on Spark: detection, behaviour scoring and reports over DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run with the job, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
