"""Operators that prepare training data for language models at cluster scale."""
