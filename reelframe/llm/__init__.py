"""Operators for preparing training data: the document operators and their queries."""
