"""Training-data operators: near-duplicate joins, archives, tokenizing, scans, mixing.

Nothing else in the package imports this subpackage.
"""
