"""Operators for training-data pipelines: extraction, near duplicates, quality, language models, packing, mixing.

The subpackage stands alone: nothing else in the library imports it.
"""

import sys

from pyspark import cloudpickle

# Helpers travel with the tasks, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
