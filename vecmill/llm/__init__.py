"""Training-data operators: vector neighbours, stable samples, deduplication, splitting, leakage, mixing, languages.

Nothing outside this subpackage imports it; it may be deleted without affecting the rest of the library.
"""
