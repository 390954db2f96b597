"""claimlake: claims-versus-facts analytics as Spark DataFrame plans.

Nothing is imported eagerly here; the subpackages stand on their own:

``functions``  column expressions (JVM side) and the few Arrow UDFs
``operators``  joins, windows and aggregates over claim and fact tables
``sources``    repository, version-control and document scans
``plans``      the full pipelines and the queries over the driver's tables
``streaming``  incremental variants (file streams, batch by batch)
``llm``        training-data operators, optional and self-contained
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their jobs: executors need
# Spark and the libraries, but no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
