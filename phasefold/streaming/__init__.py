"""Extension: forecasts over streams against a fixed library."""
