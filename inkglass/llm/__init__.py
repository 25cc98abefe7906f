"""Training-data operators: deduplication, filtering, mixing and tokenisation.

Nothing else in the package imports this subpackage.
"""
