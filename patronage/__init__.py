"""patronage: customer analytics (RFM, cohorts, CLV, clusters, models,
explanations, marketing plans) expressed as Spark DataFrame jobs.

Every public operator takes DataFrames (plus small parameters) and returns
DataFrames; the heavy work stays inside Spark plans.
"""

__version__ = "0.1.0"
