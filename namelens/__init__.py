"""Matching of identities across scripts, watchlist screening and travel-document checks as Spark jobs."""
