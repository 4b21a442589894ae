"""Training-data operators: formatting, fingerprints, near-duplicates, mixing, packing, scoring.

Nothing outside this folder imports it; ``queries.py`` lists what it registers.
"""
