"""Training-data operators: filtering, de-duplication, scoring, tokens and shards.

Nothing outside this package imports it; it can be deleted as a whole.
"""
