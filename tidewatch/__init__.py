"""Job-run, metric and log telemetry of Spark platforms as Spark DataFrames."""
