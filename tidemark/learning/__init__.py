"""Preprocessing, classifiers, search and evaluation on Spark ML."""
