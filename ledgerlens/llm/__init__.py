"""Training-data operators: packing, sharding, mixing, quality, secrets,
exact and near duplicates, toxicity, token files and token counts.

Nothing outside this subpackage imports it; ``queries`` registers its entries.
"""
