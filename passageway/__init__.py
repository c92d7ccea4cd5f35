"""Document retrieval and measured question answering as Spark jobs.

Every public function takes DataFrames and returns DataFrames; the caller owns the session.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
