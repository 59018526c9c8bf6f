"""meteorium - climate-style statistics on long daily series and grids, as Spark DataFrame operators.

Every public function takes and returns DataFrames (or Columns) and names its columns by argument.  Nothing here holds
a cluster-sized object on the driver: the only driver-side values are column lists, schemas and single counters.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python tasks travel with the job, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
