"""riskframe: credit-risk and model-monitoring operators on Spark DataFrames.

Every operator takes DataFrames (plus explicit parameters) and returns a
DataFrame.  Work stays on the executors: relational operators are plain
DataFrame / Spark SQL plans, the few operators Spark lacks are compositions
of windows, aggregates and array higher-order functions, and Python only
runs inside Arrow-batched ``mapInPandas`` / ``applyInPandas`` tasks where a
regular expression needs match offsets.
"""

from riskframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
