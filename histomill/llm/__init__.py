"""Training-data operators: URL filtering, packing, near-duplicates, secrets, fingerprints,
HTML extraction, licences, quality, repeated passages and benchmark decontamination.

Nothing else in the package imports this subpackage.
"""
