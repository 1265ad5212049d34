"""Operators over DataFrames of documents, records, spans and predictions."""
