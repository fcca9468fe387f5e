"""Readers of the given tables and the trading views derived from them."""
