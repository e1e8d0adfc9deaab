"""Training-data operators: scoring, counting, de-duplication, search and packing.

Nothing else in the package imports this subpackage.
"""
