"""Programs around a table."""
