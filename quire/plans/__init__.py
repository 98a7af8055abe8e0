"""Helpers that shape physical plans: scratch tables, range blocks, checked broadcasts."""
