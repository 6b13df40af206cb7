"""Training-data operators: deduplication, tokenisation, filtering, extraction, search and packing.

Nothing else in the library imports this subpackage. Each module holds one operator with a general DataFrame
interface; ``queries`` derives the registered queries from them.
"""
