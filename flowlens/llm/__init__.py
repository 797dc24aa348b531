"""Operators for preparing language-model training data. Nothing else in flowlens imports this."""
