"""DataFrame operators: phrases, families, decisions, clusters, reviews, labels, knowledge, features and models."""
