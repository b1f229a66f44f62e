"""Training-data operators: language, scoring, duplicates, privacy, quality, packing.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
gather what the modules of this subpackage register.
"""
