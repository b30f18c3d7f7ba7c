"""txnlake: DataFrame-to-DataFrame operators for transaction tables on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow UDFs travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
