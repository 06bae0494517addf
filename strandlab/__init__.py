"""Labelled time series on Spark: preparation, representation, clustering, scoring and model comparison."""

import sys

from pyspark import cloudpickle

# functions run inside tasks travel with the job, so the executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
