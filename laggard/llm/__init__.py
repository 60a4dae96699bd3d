"""Training-data operators on Spark: filtering, fingerprints, joins, mixing and tokenisation.

Nothing outside this subpackage imports it.
"""
