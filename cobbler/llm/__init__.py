"""Training-data operators over a ``documents`` table (see ``queries.py`` for the registered ones)."""
