"""A table's log as a stream."""
