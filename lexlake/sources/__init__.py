"""Readers of judgments, annotated records and results, and writers of what the operators make."""
