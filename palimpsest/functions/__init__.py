"""Column functions: text, paths, metadata, time, digests."""
