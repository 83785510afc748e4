"""End-to-end jobs assembled from the operators."""
