"""siftline: duplicate detection, clean-up planning and corpus preparation on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
