"""Spark-native content retrieval, concept graph and bandit analytics."""
