"""python -m palimpsest VERB STORE ...: the store's verbs on a shell's terms.

backup and restore take folders that all executors mount. Keys come from a vault; its password from PALIMPSEST_PASSWORD
or a prompt, never from the arguments.
"""

from __future__ import annotations

import argparse
import getpass
import os
import sys

from pyspark.sql import SparkSession

from palimpsest.operators.diff import restore_plan
from palimpsest.operators.rules import parse_rules
from palimpsest.plans import listing
from palimpsest.plans.backup import META, backup
from palimpsest.plans.purge import STRATEGIES, purge
from palimpsest.plans.restore import cat, restore
from palimpsest.sources.files import FileTree
from palimpsest.sources.keys import create_key, load_key
from palimpsest.sources.sinks import write_folder
from palimpsest.store import Store


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="palimpsest", description="Versioned, content-addressed data sets on Spark.")
    p.add_argument("--vault", help="file of keys; a store that was made with one needs it")
    p.add_argument("--key", default="default", help="id of the key in the vault")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *own: str, about: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, help=about)
        for x in ("store", *own):
            v.add_argument(x)
        return v

    v = verb("backup", "folder", about="add a revision")
    v.add_argument("--exclude", metavar="FILE", help="rules, one a line")
    v.add_argument("--include", metavar="FILE")
    v.add_argument("--codec", default="zlib", choices=["zlib", "gzip", "zstd", "none"])
    v.add_argument("--entropy", type=float, default=1.0, help="chunks of a higher one are stored uncompressed")
    v.add_argument("--buckets", type=int, default=16)
    v = verb("restore", "revision", "folder", about="write a revision below a folder")
    v.add_argument("--overwrite", default="update", choices=["no", "update", "yes"])
    v.add_argument("--delete", action="store_true", help="remove what the revision doesn't have")
    v = verb("list", about="revisions, newest first")
    v.add_argument("--start")
    v.add_argument("--end")
    verb("files", "revision", about="items of a revision")
    verb("cat", "path", "revision", about="one file to the standard output")
    v = verb("purge", "upto", about="drop old revisions")
    v.add_argument("--strategy", default="slow", choices=sorted(STRATEGIES))
    verb("create", about="an empty store, and its key if there is a vault")
    return p.parse_args(argv)


def _key(a: argparse.Namespace) -> bytes | None:
    if not a.vault:
        return None
    password = os.environ.get("PALIMPSEST_PASSWORD") or getpass.getpass()
    return (create_key if a.verb == "create" else load_key)(a.vault, a.key, password)


def _rules(path: str | None) -> list:
    if not path:
        return []
    with open(path, encoding="utf-8") as f:
        return parse_rules(f.read())


def _tree(spark: SparkSession, folder: str, content: bool = True):
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("content", content).load(folder)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit status: 0, or 1 where there is nothing of what was asked for."""
    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    store = Store(spark, a.store, _key(a))
    if a.verb == "create":
        store.create()
    elif a.verb == "backup":
        n = backup(store, _tree(spark, a.folder), _rules(a.exclude), _rules(a.include), a.codec, a.entropy, buckets=a.buckets)
        print("nothing changed" if n is None else f"revision {n}")
    elif a.verb == "restore":
        from pyspark.sql import functions as F

        wanted = restore(store, int(a.revision))
        os.makedirs(a.folder, exist_ok=True)
        present = _tree(spark, a.folder, False).where("path <> '/'").select("path", F.struct(*META).alias("meta"))
        plan = restore_plan(store.tree(int(a.revision)).select("path", "meta"), present, a.overwrite, a.delete)
        print(f"{write_folder(wanted, a.folder, plan)} written")
    elif a.verb == "list":
        listing.list_revisions(store, a.start, a.end).show(1000, False)
    elif a.verb == "files":
        for r in listing.list_files(store, int(a.revision)).toLocalIterator():
            print(r["line"], r["path"])
    elif a.verb == "cat":
        row = cat(store, a.path, int(a.revision)).first()
        if row is None or row["content"] is None:
            print(row["error"] if row else f"no file {a.path}", file=sys.stderr)
            return 1
        sys.stdout.buffer.write(row["content"])
    else:
        print(purge(store, int(a.upto), a.strategy))
    return 0


if __name__ == "__main__":
    sys.exit(main())
