"""Evidence analytics as composable Spark DataFrame operators."""
