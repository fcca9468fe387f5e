"""Training-data operators: one module each, numbered queries in ``queries``."""
