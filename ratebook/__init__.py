"""ratebook: per-entity statistics over event-level fact tables, on PySpark.

Every public function takes DataFrames and returns a DataFrame (or a Column).
Nothing here starts a session, and nothing collects data to the driver.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel with their code: workers need not have
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
