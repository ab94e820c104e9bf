"""Ledger analytics as Spark DataFrame functions, and operators for training data in ``llm``."""
