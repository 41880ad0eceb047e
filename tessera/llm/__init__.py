"""Training-data pipeline operators: dedup, filtering, extraction, packing, archives and media.

Nothing else in the library imports this subpackage.  ``queries`` holds the registered queries.
"""
