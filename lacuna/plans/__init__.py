"""Declared schema (codebook, units) and the composed runs."""
