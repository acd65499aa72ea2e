"""Schemas of the store's relations. A revision only adds rows; ids are BIGINT and an absent value is NULL."""

from __future__ import annotations

META = "struct<type:string,size:bigint,mode:int,uid:int,gid:int,ctime:timestamp,mtime:timestamp,atime:timestamp,link_target:string>"

#: What a source yields and a revision is made from.
FILES = "path string, name string, type string, size bigint, mode int, uid int, gid int, ctime timestamp, mtime timestamp, atime timestamp, link_target string, content binary"

RELATIONS = {
    "revisions": "revision int, created_at timestamp",
    "revision_stats": "revision int, file_count bigint, dir_count bigint, ingested_bytes bigint, stored_bytes bigint, total_bytes bigint",
    "file_tree": f"item_id bigint, parent_id bigint, list_id bigint, name string, path string, meta {META}, revision int",
    "chunk_lists": "list_id bigint, pos bigint, chunk_id bigint, offset bigint, revision int",
    "chunks": "chunk_id bigint, sha1 binary, size int, container_id bigint, revision int",
    "containers": "container_id bigint, filter string, sha256 binary, n_chunks bigint, raw_size bigint, blob binary, revision int",
    "warnings": "action string, path string, message string, revision int",
}

#: A chunk in a container is preceded by its SHA-1 (20 bytes) and its size (2 bytes).
CHUNK_HEADER = 22
