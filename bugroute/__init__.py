"""bugroute: bug-report routing on Spark.

Every public operator is a function from DataFrame to DataFrame (or from a
Column to a Column in ``bugroute.functions``).  Nothing row-sized is collected
to the driver: only small, bounded tables (category lists, class lists, model
parameters, bucket boundaries) ever leave the executors.
"""

__version__ = "0.1.0"
