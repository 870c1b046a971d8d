"""Ranked text retrieval, versioned paths and corpus preparation on Spark."""
