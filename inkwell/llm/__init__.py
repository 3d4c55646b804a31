"""Operations of a training-data pipeline. Nothing else in the library imports this package."""

import inkwell.llm as _package
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(_package)  # task functions travel with the tasks; executors need no install
