"""lakestat.plans."""
