"""Training-data operators: deduplication, scoring, filtering, sharding and search at corpus scale.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
