"""Operators for training-data pipelines: search, extraction, filtering, archives, media, mixing, tokens, language models, near copies, packing."""
