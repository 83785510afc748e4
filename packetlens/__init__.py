"""Network-traffic threat analytics as plain PySpark DataFrame functions."""
