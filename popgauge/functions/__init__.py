"""Column-level building blocks: recodes, labels, text parsing, portable hashing."""
