"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this package (and the pipeline script at the repository top)
imports it; it can be deleted without effect on the rest.
"""
