"""Training-data operators: sharding, decontamination, deduplication, packing,
quality and language classification, and nearest-neighbour search.

Nothing else in the package imports this subpackage.
"""
