"""Operators of a training-data pipeline: archives, packing, near duplicates, chat
layouts, language, sharding, fingerprints, decontamination and token counts.

Nothing else in the library imports this subpackage.  ``queries.py`` registers
one query per operator over the given tables.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with each job, so the
# library need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
