"""tidepath: PySpark-native analytics over keyed time-series panels and message corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors carry their code with them, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
