"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface; ``queries``
holds the thin registered queries over the driver tables.  Nothing outside
this subpackage (and ``corpus_pipeline.py``) imports it.
"""
