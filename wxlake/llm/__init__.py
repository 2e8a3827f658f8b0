"""Operators for preparing language-model training data; nothing else in wxlake imports this."""
