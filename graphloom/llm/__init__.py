"""Operators for preparing training text at scale: media, sharding, packing, tokens, duplicates, filters."""
