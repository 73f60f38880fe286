"""fluxlake: Spark jobs for benchmarking forecasts on irregular time series."""
