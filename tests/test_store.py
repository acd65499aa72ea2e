"""What goes into a store comes out of it."""

import datetime
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.operators import packing
from palimpsest.operators.chunking import Tttd, chunk_rows
from palimpsest.operators.ids import numbered
from palimpsest.operators.rules import parse_rules
from palimpsest.plans import listing
from palimpsest.plans.backup import backup
from palimpsest.plans.purge import purge
from palimpsest.plans.restore import cat, read_range, restore
from palimpsest.schemas import FILES
from palimpsest.sources.files import FileTree
from palimpsest.sources.sinks import decrypted, encrypted, write_folder
from palimpsest.store import Store
from palimpsest.streaming.ingest import ingest

T = datetime.datetime(2024, 1, 1)


def row(path, content=None, kind="file", shift=0, link=None):
    mode = {"file": 0o100644, "dir": 0o040755, "link": 0o120777, "fifo": 0o010644}[kind]
    return (path, path.rsplit("/", 1)[1], kind, len(content or b""), mode, 1, 1, T, T + datetime.timedelta(seconds=shift), T, link, content)


def plain_cuts(data, least, most, high, low):
    """The chunker's definition, place by place."""
    start, out = 0, []
    while start < len(data):
        n, end, backup_at = min(most, len(data) - start), None, None
        for i in range(least, n):
            window = data[start + max(least, i - 47) : start + i + 1]
            k = len(window)
            a, b = 1 + sum(window), (k + sum((k - j) * v for j, v in enumerate(window))) % 65521 or 65521
            value = (b << 16) | a
            backup_at = i + 1 if value % low == low - 1 else backup_at
            if value % high == high - 1:
                end = i + 1
                break
        start += end or backup_at or n
        out.append(start)
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 2500), st.sampled_from([(10, 300, 40, 20), (60, 500, 97, 31), (48, 200, 7, 3)]))
def test_chunks_equal_the_definition(seed, n, numbers):
    r = random.Random(seed)
    data = bytes(r.choice([0, 255, r.randrange(256)]) for _ in range(n))
    assert list(Tttd(*numbers).cuts(data)) == plain_cuts(data, *numbers)


def test_default_chunks_equal_the_definition():
    data = random.Random(5).randbytes(40_000)
    assert list(Tttd().cuts(data)) == plain_cuts(data, 1856, 11299, 2179, 1090)


def test_shifted_copy_shares_chunks(spark):
    data = random.Random(1).randbytes(400_000)
    df = spark.createDataFrame([("a", data), ("b", data[3:]), ("empty", b""), ("none", None)], "path string, content binary")
    chunks = chunk_rows(df, data=False)
    a, b = ({r.sha1 for r in chunks.where(F.col("path") == p).collect()} for p in "ab")
    assert len(a & b) > 0.9 * len(a) and chunks.where("path in ('empty', 'none')").count() == 0


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    big = random.Random(2).randbytes(200_000)
    first = [row("/a", kind="dir"), row("/a/x.txt", b"hello world" * 500), row("/a/empty", b""), row("/big.bin", big + big[3:]), row("/é/ü.txt", b"y" * 50_000), row("/l", kind="link", link="a/x.txt"), row("/loop", kind="link", link="loop"), row("/p", kind="fifo")]
    second = [r for r in first if r[0] != "/big.bin"] + [row("/z.txt", b"hello world" * 500 + b"!", shift=1)]
    s = Store(spark, str(tmp_path_factory.mktemp("s") / "store")).create()
    files = lambda rows: spark.createDataFrame(rows, FILES)
    assert backup(s, files(first), created_at="2024-01-01 00:00:00") == 1
    assert backup(s, files(first)) is None  # nothing changed
    assert backup(s, files(second), created_at="2024-01-02 00:00:00") == 2
    return s, first, second


def contents(df):
    return {r.path: bytes(r.content) for r in df.where("meta.type = 'file'").collect()}


def test_restore_is_the_inverse_of_backup(store):
    s, first, second = store
    for revision, rows in ((1, first), (2, second)):
        assert contents(restore(s, revision)) == {r[0]: r[-1] for r in rows if r[2] == "file"}


def test_reading_parts(store):
    s, first, _ = store
    whole = next(r[-1] for r in first if r[0] == "/big.bin")
    assert bytes(cat(s, "/big.bin", 1).first().content) == whole
    assert bytes(read_range(s, "/big.bin", 1, 199_990, 50).first().content) == whole[199_990:200_040]
    assert bytes(cat(s, "/a/empty", 1).first().content) == b"" and cat(s, "/a", 1).isEmpty() and cat(s, "/big.bin", 2).isEmpty()


def test_listing(store):
    s, _, _ = store
    assert [r.revision for r in listing.list_revisions(s).collect()] == [2, 1]
    assert [r.revision for r in listing.list_revisions(s, end="2024-01-01 00:00:00").collect()] == [1]
    assert [r.name for r in listing.list_dir(s, 1, "/a").collect()] == ["empty", "x.txt"]
    assert [r.path for r in listing.list_dirs(s, 1).collect()] == ["/a", "/é"]  # a missing parent is made
    assert {r.path: (r.target, r.hops) for r in listing.resolve_links(s.tree(1), 5).collect()} == {"/l": ("/a/x.txt", 1), "/loop": (None, 6)}
    assert listing.lookup(s, 2, "/z.txt").first().path == "/z.txt"
    assert [r.path for r in s.read("warnings").where("revision = 1").collect()] == ["/p"]
    assert set(listing.dump(s, 1)) >= {"chunks", "file_tree", "containers"}


def test_purge_keeps_what_is_referred_to(store, spark, tmp_path):
    s, _, second = store
    files = lambda rows: spark.createDataFrame(rows, FILES)
    assert purge(s, 1, "slow")["keep"] == 0
    assert contents(restore(s, 1)) == {r[0]: r[-1] for r in second if r[2] == "file"}
    assert backup(s, files(second[:3])) == 2 and set(contents(restore(s, 2))) == {"/a/x.txt", "/a/empty"}
    with pytest.raises(ValueError):
        purge(s, 2)


def test_corruption_is_reported(spark):
    import hashlib

    data = b"x" * 100
    raw = packing.pack_chunks([(hashlib.sha1(data).digest(), data)])
    rows = [(1, "9:zlib", hashlib.sha256(raw).digest(), packing.encode(raw, "zlib")), (2, "9:none", hashlib.sha256(b"").digest(), raw), (3, "9:lost", b"", b"")]
    out = {r.container_id: r for r in packing.open_containers(spark.createDataFrame(rows, "container_id long, filter string, sha256 binary, blob binary")).collect()}
    assert bytes(out[1].data) == data and out[1].error is None and "corruption" in out[2].error and "codec" in out[3].error


def test_next_fit_by_hand(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([50, 30, 40, 200, 1])], "i int, size int")
    got = [(r.container, r.offset) for r in packing.next_fit(df, ["i"], 150).orderBy("i").collect()]
    assert got == [(0, 0), (0, 72), (1, 0), (2, 0), (3, 0)]


def test_numbers_are_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [r.id for r in numbered(df, ["x"]).orderBy("x").collect()] == list(range(1, 1001))


def test_include_means_nothing_without_exclude(spark):
    from palimpsest.operators.rules import kept

    df = spark.createDataFrame([("a",), ("r/b",)], "path string")
    assert kept(df, [], parse_rules("a")).count() == 2
    assert [r.path for r in kept(df, parse_rules("r/r/\n\n")).collect()] == ["a"]


def test_tree_source_and_folder_sink(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/f").write_bytes(b"1")
    (tmp_path / "in/.h").write_bytes(b"")
    os.symlink("sub/f", tmp_path / "in/l")
    spark.dataSource.register(FileTree)
    tree = spark.read.format("filetree").load(str(tmp_path / "in"))
    assert {r.path: r.type for r in tree.select("path", "type").collect()} == {"/.h": "file", "/sub": "dir", "/sub/f": "file", "/l": "link"}
    assert spark.read.format("filetree").option("hidden", False).load(str(tmp_path / "in")).count() == 3
    s = Store(spark, str(tmp_path / "store")).create()
    backup(s, tree)
    assert write_folder(restore(s, 1), str(tmp_path / "out")) == 4
    assert (tmp_path / "out/l").read_bytes() == b"1" and os.path.islink(tmp_path / "out/l")


def test_sealed_with_another_key_is_null(spark):
    df = encrypted(spark.createDataFrame([(bytearray(b"x"),)], "blob binary"), b"k" * 16)
    assert decrypted(df, b"j" * 16).first().blob is None


def test_stream_becomes_revisions(spark, tmp_path):
    spark.createDataFrame([row("/a", b"1"), row("/b", b"2")], FILES).write.parquet(str(tmp_path / "in"))
    s = Store(spark, str(tmp_path / "store")).create()
    for _ in range(2):  # the second run finds nothing new
        ingest(s, spark.readStream.schema(FILES).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert s.last_revision() == 1 and len(contents(restore(s, 1))) == 2


@pytest.mark.parametrize("codec", ["none", "zlib", "gzip", "zstd"])
def test_codecs(codec):
    for raw in (b"", b"a" * 100_000, bytes(range(256)) * 9):
        blob = packing.encode(raw, codec)
        assert packing.decode(blob, codec) == raw and blob == packing.encode(raw, codec)


@pytest.mark.parametrize(("start", "length"), [(0, 10), (0, 10**9), (199_990, 50), (399_990, 50), (10**9, 5), (5, 0)])
def test_ranges(spark, tmp_path, start, length):
    big = random.Random(2).randbytes(200_000)
    s = Store(spark, str(tmp_path / "store")).create()
    backup(s, spark.createDataFrame([row("/big", big + big), row("/empty", b""), row("/d", kind="dir")], FILES))
    assert bytes(read_range(s, "/big", 1, start, length).first().content) == (big + big)[start : start + length]
    assert bytes(read_range(s, "/empty", 1, start, length).first().content) == b""
    assert read_range(s, "/d", 1, start, length).isEmpty() and read_range(s, "/none", 1, start, length).isEmpty()


def test_encrypted_store(spark, tmp_path):
    key, data = b"k" * 32, [row("/a", b"secret words " * 900), row("/b", b"secret words " * 901)]
    s = Store(spark, str(tmp_path / "store"), key).create()
    for r in (data[:1], data, data[1:]):
        backup(s, spark.createDataFrame(r, FILES), codec="none")
    for sealed in Store(spark, s.path).read("containers").collect():
        assert b"secret" not in bytes(sealed.blob)
    purge(s, 1)
    assert contents(restore(s, 1)) == {r[0]: r[-1] for r in data} and contents(restore(s, 2)) == {"/b": data[1][-1]}
    assert {r.content for r in restore(Store(spark, s.path, b"x" * 32), 2).where("path = '/b'").collect()} == {None}
    assert [r.revision for r in s.revisions().orderBy("revision").collect()] == [1, 2]


def test_purge_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "store")).create()
    for k in range(3):
        backup(s, spark.createDataFrame([row("/a", b"%d" % k * 5000, shift=k), row("/b", b"same" * 5000)], FILES))
    monkeypatch.setattr(s, "_point", lambda generation: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        purge(s, 2)
    again = Store(spark, s.path)
    assert again.last_revision() == 3 and contents(restore(again, 1))["/a"] == b"0" * 5000


def test_chunks_of_large_files_equal_the_definition(monkeypatch):
    from palimpsest.operators import chunking

    data = random.Random(9).randbytes(60_000)
    want = list(Tttd().cuts(data))
    for step in (1, 48, 1000, 59_000):
        monkeypatch.setattr(chunking, "STEP", step) if step > 1 else None
        assert list(Tttd().cuts(data)) == want


def test_shell(spark, tmp_path, capsysbinary, monkeypatch):
    from palimpsest.__main__ import main

    monkeypatch.setenv("PALIMPSEST_PASSWORD", "p")
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/d/f").write_bytes(b"one")
    os.utime(tmp_path / "in/d/f", (1, 86400))
    (tmp_path / "in/d/f").chmod(0o640)
    store, vault = str(tmp_path / "store"), ["--vault", str(tmp_path / "keys")]
    run = lambda *a: main([*vault, *map(str, a)], spark)
    assert run("create", store) == 0 and run("backup", store, tmp_path / "in") == 0
    (tmp_path / "in/new").write_bytes(b"two")
    assert run("backup", store, tmp_path / "in") == 0
    capsysbinary.readouterr()
    assert run("cat", store, "/d/f", 1) == 0 and capsysbinary.readouterr().out == b"one" and run("cat", store, "/none", 1) == 1
    assert run("restore", store, 2, tmp_path / "out") == 0 and (tmp_path / "out/new").read_bytes() == b"two"
    f = (tmp_path / "out/d/f").stat()
    assert f.st_mode & 0o777 == 0o640 and f.st_mtime == 86400
    assert run("restore", store, 1, tmp_path / "out", "--delete") == 0 and not (tmp_path / "out/new").exists()
    assert run("list", store) == 0 and run("files", store, 2) == 0 and run("purge", store, 1) == 0
    assert b"/d/f" in capsysbinary.readouterr().out


def test_paths_stay_in_the_folder(tmp_path):
    from palimpsest.sources.sinks import _placed

    with pytest.raises(ValueError):
        _placed(str(tmp_path), "/../x")


def test_stream_forgets_within_a_watermark(spark, tmp_path):
    from palimpsest.streaming.ingest import new_contents

    spark.createDataFrame([("a", T), ("a", T), ("b", T)], "sha1 string, at timestamp").write.parquet(str(tmp_path / "in"))
    rows = new_contents(spark.readStream.schema("sha1 string, at timestamp").parquet(str(tmp_path / "in")), time="at")
    rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.sha1 for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
