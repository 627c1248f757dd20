"""Semi-structured data on Spark: JSON documents, schema inference, shredding, Parquet, streams, training corpora.

Functions of this package are pickled by value, so that executors run them without having the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
