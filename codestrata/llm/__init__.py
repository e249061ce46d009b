"""Operators for preparing training text: toxicity, deduplication, decontamination, formatting, mixing, counting."""
