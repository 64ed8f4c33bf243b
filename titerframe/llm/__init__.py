"""Training-data operators: packing, chat formatting, deduplication, mixing, search, classifiers, URL filters.

Nothing outside this subpackage imports it.
"""
