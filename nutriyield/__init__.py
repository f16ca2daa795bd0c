"""nutriyield: nutrition-sensitive fisheries yield analytics on Spark.

Every operator is a function from DataFrames to a DataFrame.  Null, tie and
ordering rules are explicit so results do not depend on partitioning.
"""

from nutriyield.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
