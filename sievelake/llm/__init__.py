"""Operators that prepare large text corpora; nothing else in the library needs them."""
