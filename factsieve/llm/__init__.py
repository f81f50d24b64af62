"""Operators of a training-data pipeline; their queries are in ``factsieve.llm.queries``."""
