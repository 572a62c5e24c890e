"""Time-indexed speech and conversation analytics as Spark DataFrame operators."""
