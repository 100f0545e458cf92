"""stemma: a PySpark-native engine for bibliometric corpora.

Layers: ``sources`` (readers and sinks), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame), ``plans`` (named queries and their
oracle SQL), ``streaming`` (incremental ingest).  Operators for training-data
work on text live in the optional subpackage ``llm``; nothing here imports it.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so the package needn't be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
