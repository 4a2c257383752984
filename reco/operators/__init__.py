"""Operators: aggregates, features, similarity, neighbourhood predictors, popularity, interactions, factorization, classifiers, evaluation."""
