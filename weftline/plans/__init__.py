"""Helpers that shape physical plans: cutting lineage, range layouts, checked broadcasts."""
