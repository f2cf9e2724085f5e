"""Tidemark: ordered, versioned key-value tables on Spark."""
