"""Load decomposition and forecasting of quarter-hourly series as Spark DataFrame pipelines."""
