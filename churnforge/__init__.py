"""churnforge: churn analytics as Spark DataFrame jobs.

Every operator takes and returns DataFrames; fitted state (scaler
parameters, vocabularies, quotas) is itself a small DataFrame or a
scalar subquery, so plans stay lazy and distributed.
"""

__version__ = "0.1.0"
