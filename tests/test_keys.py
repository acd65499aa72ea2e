import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.digests import from_quoted_printable, hex_dump, quoted_printable
from palimpsest.sources.keys import create_key, load_key
from palimpsest.sources.sinks import export_relation, import_relation


def test_vault(tmp_path):
    vault = str(tmp_path / "keys")
    key = create_key(vault, "a", "secret")
    assert load_key(vault, "a", "secret") == key and create_key(vault, "b", "secret") != key
    with pytest.raises(KeyError):
        load_key(vault, "c", "secret")
    with pytest.raises(KeyError):
        create_key(vault, "a", "secret")
    with pytest.raises(PermissionError):
        load_key(vault, "a", "other")
    os.chmod(vault, 0o644)
    with pytest.raises(PermissionError):
        load_key(vault, "a", "secret")


def test_export_is_invertible_and_checked(spark):
    rows = spark.createDataFrame([(1, "é", None), (2, None, 0.5)], "a long, b string, c double")
    out = export_relation(rows, b"k" * 32)
    assert {tuple(r) for r in import_relation(out, b"k" * 32, "a long, b string, c double").collect()} == {tuple(r) for r in rows.collect()}
    with pytest.raises(Exception, match="damaged"):
        import_relation(out, b"j" * 32, "a long, b string, c double").collect()


def test_encodings(spark):
    df = spark.createDataFrame([("a=é\n",), (None,)], "s string")
    assert [r[0] for r in df.select(from_quoted_printable(quoted_printable("s"))).collect()] == ["a=é\n", None]
    assert df.select(hex_dump(F.encode(F.lit("abcde"), "UTF-8"), 4)).first()[0] == "61 62 63 64 \n65"
