"""Operators of a training-data pipeline, beside the retrieval library and unused by it."""
