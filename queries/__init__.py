"""The registered queries and the SQL that must give the same rows."""

import sys

from pyspark import cloudpickle

# Fixture writers run inside tasks; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
