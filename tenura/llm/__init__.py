"""Training-data operators: dedup, decontamination, packing, filtering, extraction.

Nothing else in the library imports this package; it imports only general
helpers (session, checkpoint folder) from the rest.
"""
