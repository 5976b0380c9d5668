"""Search-quality analytics over search logs and catalogues, as Spark DataFrame operators.

Functions sent to Python workers carry this package with them, so executors need no installation of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
