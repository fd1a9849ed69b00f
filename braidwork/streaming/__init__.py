"""Counting while records arrive. The batch operators are the reference for what comes out."""
