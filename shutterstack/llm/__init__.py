"""Operators that prepare training data: survivors, neighbours, groups, packing, mixing and residue."""
