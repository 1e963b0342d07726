"""Fleet telemetry and geofencing on Spark DataFrames, in batch and in streams."""
