"""tidepanel: Spark jobs for panels of financial time series.

Sub-packages
------------
functions   column expressions (dates, scalars, text)
operators   DataFrame -> DataFrame building blocks on the long panel
sources     schemas, readers, writers and the latest-per-key merge
plans       forecasting, evaluation, refresh and page-level views
streaming   Structured Streaming jobs for bars, news and prices
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so the workers need no copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
