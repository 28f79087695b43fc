"""Operators for training data: quality, language models, duplicates, tokens, decontamination."""
