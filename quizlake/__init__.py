"""Quiz data on Spark: notes, model responses, quizzes, scoring and progress as DataFrame functions."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with their code, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
