"""fleetlens: search-fleet monitoring analytics on Spark DataFrames.

Every operator is a lazy ``DataFrame -> DataFrame`` transformation built from
built-in functions, joins, aggregations and window specifications.
"""

from fleetlens.session import build_session, checkpoint_dir, write_shared

__all__ = ["build_session", "checkpoint_dir", "write_shared"]
