"""Listing analytics on Spark: typed listings, one URL identity, merge, work matching, scoring and feeds."""
