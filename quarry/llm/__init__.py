"""Training-data operators: ten self-contained modules, each with its query in ``queries``."""
