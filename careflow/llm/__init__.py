"""Operators for training-data corpora: near duplicates, filters, secrets, mixing, tokens, language models, chat logs."""
