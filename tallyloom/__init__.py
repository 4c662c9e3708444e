"""Review analytics as composable Spark DataFrame operators."""
