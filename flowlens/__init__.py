"""Payment-flow analytics as plain PySpark DataFrame functions."""
