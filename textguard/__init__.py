"""textguard: Spark-native masking, auditing and project-scoped search over text columns.

Every operator takes and returns DataFrames (batch or streaming) and is built from
Spark SQL functions, joins, windows and keyed state. See README.md for the map from
operators to modules.
"""

from textguard.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
