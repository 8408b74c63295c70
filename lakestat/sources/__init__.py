"""lakestat.sources."""
