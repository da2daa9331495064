"""Operators that act on a table: reading, committing, recovering, vacuuming, checking."""
