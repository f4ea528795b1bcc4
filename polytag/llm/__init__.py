"""Operators for building training corpora: classifiers, mixing, near-duplicates, redaction, scoring.

Nothing else in the library imports this package; ``__spark_entry__.py`` registers its queries
only when it can be imported.
"""
