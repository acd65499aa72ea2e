import pytest
from pyspark.sql import functions as F

from palimpsest.functions import digests, meta, paths, text, time


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(column).collect()]



@pytest.mark.parametrize(
    ("column", "rows", "want"),
    [
        (lambda S: text.to_number(S), ["12ab", "x", "", " -7"], [12, 0, 0, -7]),
        (lambda S: text.to_number(S, "double"), ["1.5e1x", "."], [15.0, 0.0]),
        (lambda S: text.parse_int(S), ["0x1F", "0b101", "017", "9z"], [31, 5, 15, 9]),
        (lambda S: text.reverse_find(S, "/"), ["a/b/c", "abc"], [3, -1]),
        (lambda S: text.caseless_find(S, "B/"), ["ab/c"], [1]),
        (lambda S: text.find_any(S, "]-^"), ["ab-c", "abc"], [2, -1]),
        (lambda S: text.reverse_find_any(S, "ab"), ["abcc"], [1]),
        (lambda S: text.find_any(S, "ab", negated=True), ["abcc"], [2]),
        (lambda S: text.count(S, "aa"), ["aaaaa"], [2]),
        (lambda S: text.mid(S, -3, -1), ["abcdef", "ab"], ["de", "a"]),
        (lambda S: text.up_to(S, "/"), ["a/b", "ab"], ["a", "ab"]),
        (lambda S: text.up_to(S, "/", include=True), ["a/b", "ab"], ["a/", ""]),
        (lambda S: text.from_(S, "/", last=True), ["a/b/c", "ab"], ["c", ""]),
        (lambda S: text.from_(S, "/", include=True), ["a/b", "ab"], ["/b", "ab"]),
        (lambda S: text.from_to(S, "<", ">"), ["x<y>z", "x<y"], ["y", ""]),
        (lambda S: text.drop_up_to(S, ":"), ["k:v", "kv"], ["v", "kv"]),
        (lambda S: text.replace_at(S, 1, 2, "XYZ"), ["abcd", ""], ["aXYZd", " XYZ"]),
        (lambda S: text.insert(S, 1, "-"), ["ab"], ["a-b"]),
        (lambda S: text.remove(S, 0, 1), ["ab"], ["b"]),
        (lambda S: text.aligned(S, 5, "right", "."), ["ab", "abcdef"], ["...ab", "abcdef"]),
        (lambda S: text.aligned(S, 5, "center", "."), ["ab"], [".ab.."]),
        (lambda S: text.caseless_replace(S, "a.b", "$1"), ["xA.By", "xaaby"], ["x$1y", "xaaby"]),
        (lambda S: text.replace_tokens(S, "[]", "_"), ["a[b]"], ["a_b_"]),
        (lambda S: text.replace_first(S, "(b+)", "<\\1>", 2), ["abbabab"], ["a<bb>a<b>ab"]),
        (lambda S: text.replace_first(S, "b", "", -1), ["abab"], ["aa"]),
        (lambda S: text.with_suffix(S), ["10K", "3m", "7"], [10240, 3145728, 7]),
        (lambda S: text.legible_size(text.to_number(S)), ["0", "1023", "1536", "1073741824"], ["0.0B", "1023.0B", "1.5KB", "1.0GB"]),
        (lambda S: text.legible_time(text.to_number(S)), ["999", "61000", "90000000"], ["999ms", "1min", "1day"]),
        (lambda S: text.find_key(F.split(S, "\n"), "b"), ["a: 1\nb: 2", "a: 1"], ["2", None]),
        (lambda S: paths.normalized(S), ["/a/./b/../c//", "../x", "/..", "a/..", ""], ["/a/c", "../x", "/", ".", ""]),
        (lambda S: paths.with_separator(S, False), ["/a//", "//", "a"], ["/a", "/", "a"]),
        (lambda S: paths.ancestors(S), ["/a/b"], [["", "/a"]]),
        (lambda S: F.date_format(time.parse_compact(S), "yyyyMMddHHmmss"), ["2024", "20240229", "20230229", "x"], ["20240101000000", "20240229000000", None, None]),
        (lambda S: time.iso8601(time.from_date_text(S)), ["Thu, 01 Feb 2024 03:04:05 GMT", "2024-02-01T03:04:05Z", ""], ["2024-02-01T03:04:05Z", "2024-02-01T03:04:05Z", None]),
        (lambda S: digests.adler32(F.encode(S, "UTF-8")), ["Wikipedia", None], [0x11E60398, None]),
        (lambda S: digests.entropy(F.encode(S, "UTF-8")), ["aaaa", "", "ab"], [0.0, 1.0, 0.125]),
    ],
)
def test_function(spark, column, rows, want):
    assert values(spark, rows, column(F.col("s"))) == want


def test_metadata_text_is_invertible(spark):
    stat = {f: F.lit(i + 7).cast("bigint") for i, f in enumerate(meta.FIELDS)} | {"mode": F.lit(0o120777).cast("bigint")}
    row = spark.range(1).select(meta.from_text(meta.to_text(stat, F.lit("a/b"))).alias("x"), meta.from_text(F.lit("W1/2")).alias("y")).first()
    assert (row.x.type, row.x.permissions, row.x.size, row.x.link_target, row.y) == ("link", 0o777, 10, "a/b", None)


def test_permission_bits(spark):
    row = spark.range(1).select(meta.permission_text(F.lit(0o754)), meta.may(F.lit(0o640), F.lit(1), F.lit(2), 4, 9, 2), meta.may(F.lit(0o640), F.lit(1), F.lit(2), 2, 9, 2)).first()
    assert tuple(row) == ("rwxr-xr--", True, False)


def test_base85_is_that_of_python(spark):
    import base64
    import random

    rows = [random.Random(n).randbytes(n) for n in range(40)] + [None, b"\0" * 8, b"\xff" * 7]
    df = spark.createDataFrame([(r,) for r in rows], "b binary").select("b", digests.base85(F.col("b")).alias("e")).select("b", "e", digests.unbase85(F.col("e")).alias("d"))
    assert all((r.b is None and r.e is None and r.d is None) or (r.e == base64.b85encode(bytes(r.b)).decode() and bytes(r.d) == bytes(r.b)) for r in df.collect())
