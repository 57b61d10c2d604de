"""Fleet-tracking analytics as Spark DataFrame operators."""
