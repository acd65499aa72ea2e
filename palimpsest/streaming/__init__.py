"""Incremental ingestion: a stream of files becomes revisions."""
