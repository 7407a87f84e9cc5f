"""Review graph analytics as Spark DataFrame operators."""
