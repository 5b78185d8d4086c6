"""Training-data operators: deduplication, packing, classification, search and archives.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
