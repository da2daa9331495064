"""Relational plans over the log: every question about versions is a query on one ops table."""
