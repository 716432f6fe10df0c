"""Trip analytics and data preparation as plain Spark DataFrame functions."""
