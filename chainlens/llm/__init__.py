"""Training-data operators over text tables (documents, pages, labels).

One module per operator; ``queries`` registers the thin ``opN_*`` queries and
their SQL.  Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so these
# need no copy of the package.  Broadcast variables hold plain data only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
