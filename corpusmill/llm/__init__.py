"""Operators of a training-data pipeline: search, language, packing, shards, duplicates, quality, archives, mixes, pages, chats."""
