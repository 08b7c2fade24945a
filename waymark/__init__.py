"""Rule checking, mining and evaluation of ordered event sequences on Spark."""
