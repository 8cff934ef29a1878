"""SQL-workload mining and Text-to-SQL scoring as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python helpers travel inside the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
