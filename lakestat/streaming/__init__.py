"""lakestat.streaming."""
