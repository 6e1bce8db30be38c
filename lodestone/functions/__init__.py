"""Part of Lodestone; see the module docstrings."""
