"""SQL functions over tables by path."""
