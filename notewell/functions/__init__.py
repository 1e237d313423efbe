"""Column functions. None of them needs a Python worker except the sequence-ratio helpers."""
