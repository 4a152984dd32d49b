"""A Spark-native engine for corpus retrieval analytics and training-data preparation.

Python functions that run inside executors are pickled by value, so the cluster does not need this
package installed on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
