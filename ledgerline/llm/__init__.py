"""Operators for preparing language-model training data, written for Spark.

One module per operator; :mod:`ledgerline.llm.queries` registers one query per
operator with its oracle SQL where SQL can state it.  Nothing outside this
subpackage imports it.

Task code travels by value, so Python workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
