"""Column functions: expressions only, no Python in the data path."""
