"""Registered queries of the functions, sources, sinks and streams that no query of the store calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import digests, meta, paths, text, time
from palimpsest.operators import chunking, dedup, diff, packing
from palimpsest.operators.ids import scratch, shared_dir
from palimpsest.plans import listing
from palimpsest.queries import FILES_SQL, _files, _kept_store, _table, query


def _nations(spark, sf_dir):
    """path, meta and content of one file for each nation, below a folder for each region, and a link to each."""
    n = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder = F.concat(F.lit("/"), "r_name")
    t = F.timestamp_seconds(F.lit(86400) * (F.col("n_nationkey") + 1))
    null = F.lit(None)

    def rows(df, path, kind, mode, content, target):
        m = F.struct(F.lit(kind).alias("type"), F.coalesce(F.octet_length(content), F.lit(0)).cast("bigint").alias("size"), mode.cast("int").alias("mode"), null.cast("int").alias("uid"), null.cast("int").alias("gid"), t.alias("ctime"), t.alias("mtime"), t.alias("atime"), target.cast("string").alias("link_target"))
        return df.select(path.alias("path"), m.alias("meta"), content.cast("binary").alias("content"))

    own = F.concat(folder, F.lit("/"), "n_name", F.lit(".txt"))
    files = rows(n, own, "file", F.lit(0o600) + F.col("n_nationkey") % 8, F.repeat("n_name", F.col("n_nationkey") * 100), null)
    links = rows(n, F.concat(folder, F.lit("/.to "), "n_name"), "link", F.lit(0o777), null.cast("string"), F.concat("n_name", F.lit(".txt")))
    return files.unionByName(links).unionByName(rows(n.dropDuplicates(["r_name"]), folder, "dir", F.lit(0o755), null.cast("string"), null))


@query("""WITH n AS (SELECT *, '/' || r_name AS folder, repeat(n_name, n_nationkey * 100) AS content FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT folder || '/' || n_name || '.txt' AS path, n_name || '.txt' AS name, 'file' AS type, CAST(length(content) AS BIGINT) AS size, CAST(384 + n_nationkey % 8 AS INTEGER) AS permissions, CAST(86400 * (n_nationkey + 1) AS BIGINT) AS mtime, NULL AS link_target, sha1(content) AS sha1 FROM n
UNION ALL SELECT folder || '/.to ' || n_name, '.to ' || n_name, 'link', 0, NULL, CAST(86400 * (n_nationkey + 1) AS BIGINT), n_name || '.txt', NULL FROM n UNION ALL SELECT DISTINCT folder, r_name, 'dir', 0, 493, NULL, NULL, NULL FROM n""")
def folder_round_trip(spark, sf_dir):
    """S1 S2 S7-S10 S21 S25 S28 R4 E-1: files, folders and links written below a folder, and the folder scanned."""
    from palimpsest.sources.files import FileTree
    from palimpsest.sources.sinks import write_folder

    folder = scratch(spark.range(1), "folder").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") + "/tree"
    write_folder(_nations(spark, sf_dir), folder)
    spark.dataSource.register(FileTree)
    rows = spark.read.format("filetree").option("partitions", 8).load(folder)
    kept = F.when(F.col("type") != "link", F.col("mode").bitwiseAND(0o777))
    return rows.select("path", "name", "type", "size", kept.alias("permissions"), F.when(F.col("type") != "dir", F.unix_seconds("mtime")).alias("mtime"), "link_target", F.sha1("content").alias("sha1"))


@query("""SELECT r_name || '/' || n_name || '.txt' AS path, n_name || '.txt' AS name, CAST(length(n_name) * n_nationkey * 100 AS BIGINT) AS size FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE '%1'""")
def binary_files(spark, sf_dir):
    """Spark's own reader over a written folder, by a name pattern."""
    from palimpsest.sources.files import read_files
    from palimpsest.sources.sinks import write_folder

    folder = scratch(spark.range(1), "folder").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") + "/tree"
    write_folder(_nations(spark, sf_dir), folder)
    rows = read_files(spark, f"file://{folder}", "*1.txt")
    return rows.select(F.replace(F.substring_index("path", "/", -2), F.lit("%20"), F.lit(" ")).alias("path"), F.replace(F.col("name"), F.lit("%20"), F.lit(" ")).alias("name"), "size")


@query("""SELECT c_custkey, m, uid, gid, CASE WHEN uid = 3 THEN m // 64 % 8 WHEN gid = 2 THEN m // 8 % 8 ELSE m % 8 END // 4 = 1 AS may_read, (CASE WHEN uid = 3 THEN m // 64 % 8 WHEN gid = 2 THEN m // 8 % 8 ELSE m % 8 END) % 2 = 1 AS may_run
FROM (SELECT c_custkey, CAST(c_custkey % 512 AS INTEGER) AS m, CAST(c_custkey % 5 AS INTEGER) AS uid, CAST(c_custkey % 3 AS INTEGER) AS gid FROM customer)""")
def permissions(spark, sf_dir):
    """whether a user may read or run as owner, group or other."""
    c = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (c % 512).cast("int").alias("m"), (c % 5).cast("int").alias("uid"), (c % 3).cast("int").alias("gid"))
    may = lambda want: meta.may(F.col("m"), F.col("uid"), F.col("gid"), want, 3, 2)
    return rows.withColumns({"may_read": may(4), "may_run": may(1)})


@query("""SELECT '/n/' || n_nationkey AS path, CASE WHEN n_nationkey <= 20 THEN '/n/0' END AS target, CAST(CASE WHEN n_nationkey <= 20 THEN n_nationkey ELSE 21 END AS INTEGER) AS hops, n_nationkey > 20 AS escapes FROM nation WHERE n_nationkey > 0
UNION ALL SELECT '/n/out', '/etc/x', 1, true""")
def links(spark, sf_dir):
    """Links followed up to 20 hops, a join for each, and those that lead out of the root."""
    k = F.col("n_nationkey")
    link = lambda path, target: F.struct(F.when(target.isNull(), "file").otherwise("link").alias("type"), target.alias("link_target"))
    rows = _table(spark, sf_dir, "nation").select(F.concat(F.lit("/n/"), k.cast("string")).alias("path"), link(k, F.when(k > 0, F.concat(F.lit("./x/../"), (k - 1).cast("string")))).alias("meta"))
    rows = rows.union(spark.range(1).select(F.lit("/n/out"), link(k, F.lit("../etc/./x"))))
    found, out = listing.resolve_links(rows, 20), listing.escaping_links(rows, "/n/")
    far = F.col("path").isNotNull()
    return found.join(out.select("path", F.lit(True).alias("_out")), "path", "left").where(far).select("path", "target", "hops", (F.coalesce("_out", F.lit(False)) | F.col("target").isNull()).alias("escapes"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, source IN ('src0', 'src3') AS regular, size > 0 AS has_content, regexp_full_match(CAST(doc_id AS VARCHAR), '[0-9]+') AS digits, doc_id >= 0 AND size <= 100000 AS in_bounds FROM files""")
def row_filters(spark, sf_dir):
    """What is skipped or kept by kind, content, digits and bounds."""
    kind = F.when(F.col("source").isin("src0", "src3"), "file").otherwise("fifo")
    from palimpsest.plans.backup import REGULAR

    name = F.col("doc_id").cast("string")
    return _files(spark, sf_dir).select("doc_id", kind.isin(*REGULAR).alias("regular"), (F.col("size") > 0).alias("has_content"), (text.find_any(name, "0123456789", negated=True) < 0).alias("digits"), F.col("doc_id").between(0, 2**62).__and__(F.col("size") <= 100000).alias("in_bounds"))


@query(f"""WITH {FILES_SQL} SELECT count(*) FILTER (doc_id % 5 = 2) > 0 AS differs, false AS same FROM files""")
def worth_saving(spark, sf_dir):
    """whether anything differs between two trees."""
    now = _files(spark, sf_dir).select("path", "size", "sha1")
    before = _files(spark, sf_dir).where("doc_id % 5 <> 2").select("path", "size", "sha1")
    answer = [diff.worth_saving(diff.tree_diff(before, now)), diff.worth_saving(diff.tree_diff(now, now))]
    return spark.range(1).select(F.lit(answer[0]).alias("differs"), F.lit(answer[1]).alias("same"))


@query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) || 'K' AS given, p_partkey * 1024 AS bytes, p_partkey * 31 % 4096 AS parsed, p_partkey % 64 AS binary_digits, round(p_retailprice, 2) AS price, strpos(p_brand, '#') - 1 AS first_mark, CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^(.*)[aeiou]', 1)) ELSE -1 END AS last_vowel,
split_part(p_name, ' ', 2) AS token, substr(p_name, 1, strpos(p_name, ' ') - 1) AS head, substr(p_name, strpos(p_name, ' ') + 1) AS tail, substr(p_name, 1, 1) || 'XY' || substr(p_name, 4) AS replaced, substr(p_name, 1, 2) || '-' || substr(p_name, 3) AS inserted, substr(p_name, 3) AS removed,
p_size || ':' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS formatted, p_size AS scanned, ascii(p_name) AS code, length(p_name) AS points, true AS utf8, true AS quoted, CAST(regexp_extract(p_brand, '#([0-9])([0-9]?)', 1) AS INTEGER) AS digit, strpos(p_brand, '#') - 1 AS at,
'v ' || p_size AS value, p_brand || '/' || p_size AS joined, p_name < p_type AS less, upper(to_hex(p_partkey)) AS hexed FROM part""")
def more_text_functions(spark, sf_dir):
    """Numbers, tokens, places, edits, formats, matches and lines of `key: value`."""
    p, name, brand, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    halves, match = text.split_at(name, " "), text.captures(brand, "#([0-9])([0-9]?)", 2)
    given, formatted = F.concat(p.cast("string"), F.lit("K")), F.format_string("%d:%08d", "p_size", "p_partkey")
    lines = F.split(F.concat(F.lit("a: 1\nsize: v "), F.col("p_size").cast("string"), F.lit("\nsize: other")), "\n")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", given.alias("given"), text.with_suffix(given).alias("bytes"), text.parse_int(F.concat(F.lit("0x"), F.hex(p * 31 % 4096), F.lit("zz"))).alias("parsed"), text.parse_int(F.concat(F.lit("0b"), F.bin(p % 64))).alias("binary_digits"),
        F.round(text.to_number(F.concat(F.col("p_retailprice").cast("string"), F.lit(" eur")), "double"), 2).alias("price"), text.find_any(brand, "#!").cast("bigint").alias("first_mark"), text.reverse_find_any(name, "aeiou").cast("bigint").alias("last_vowel"),
        text.token(name, " ", 1).alias("token"), halves["head"].alias("head"), halves["tail"].alias("tail"), text.replace_at(name, 1, 2, "XY").alias("replaced"), text.insert(name, 2, "-").alias("inserted"), text.remove(name, 0, 2).alias("removed"),
        formatted.alias("formatted"), F.regexp_extract(formatted, "^([0-9]+):", 1).cast("int").alias("scanned"), text.code_point(name).alias("code"), F.char_length(name).cast("bigint").alias("points"), F.is_valid_utf8(name).alias("utf8"),
        (digests.from_quoted_printable(digests.quoted_printable(F.concat(name, F.lit(" = é")))) == F.concat(name, F.lit(" = é"))).alias("quoted"), match["groups"][1].cast("int").alias("digit"), match["position"].cast("bigint").alias("at"),
        text.find_key(lines, "size").alias("value"), F.concat_ws("/", brand, F.col("p_size").cast("string")).alias("joined"), (name < kind).alias("less"), F.hex(p).alias("hexed"),
    )


@query("""SELECT o_orderkey, o_orderdate AS made, o_orderdate + INTERVAL 2 HOUR AS cairo, o_orderdate AS back FROM (SELECT o_orderkey, date_trunc('second', o_orderdate) AS o_orderdate FROM orders)""")
def more_time_functions(spark, sf_dir):
    """A time from its parts, and local time of a zone of a fixed offset."""
    t = F.col("o_orderdate")
    made = time.make(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), F.floor(F.second(t)))
    there = time.to_local(made, "+02:00")
    return _table(spark, sf_dir, "orders").select("o_orderkey", made.cast("timestamp_ntz").alias("made"), there.cast("timestamp_ntz").alias("cairo"), time.to_utc(there, "+02:00").cast("timestamp_ntz").alias("back"))


@query("""WITH b AS (SELECT c_custkey, c_name, length(c_name) AS n, unnest(range(1, length(c_name) + 1)) AS i FROM customer), v AS (SELECT c_custkey, min(c_name) AS c_name, max(n) AS n, sum(ascii(substr(c_name, i, 1))) AS a, sum((n - i + 1) * ascii(substr(c_name, i, 1))) AS s FROM b GROUP BY c_custkey)
SELECT c_custkey, CAST(((n + s) % 65521) * 65536 + (1 + a) % 65521 AS BIGINT) AS adler, upper(hex(encode(substr(c_name, 1, 1)))) || ' ' || upper(hex(encode(substr(c_name, 2, 1)))) AS dump, upper(sha256(c_name)) || '.#' AS container, true AS key_again FROM v""")
def more_digest_functions(spark, sf_dir):
    """Adler-32, a hexadecimal dump, container names, a key from a password."""
    b = F.encode("c_name", "UTF-8")
    again = digests.derive_key("p", b"salt", 32, 10) == digests.derive_key("p", b"salt", 32, 10) != digests.derive_key("q", b"salt", 32, 10)
    return _table(spark, sf_dir, "customer").select("c_custkey", digests.adler32(b).alias("adler"), F.left(digests.hex_dump(b), F.lit(5)).alias("dump"), packing.container_name(F.unhex(digests.sha256(b))).alias("container"), F.lit(again).alias("key_again"))


@query("SELECT doc_id, upper(sha1(text)) AS whole FROM documents WHERE text <> ''")
def hashed_parts(spark, sf_dir):
    """E-3 E-5: the digest of a text from its lines, hashed as they stream by in order."""
    lines = chunking.chunk_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return digests.digest_of_parts(lines, "doc_id", "pos").select("doc_id", F.hex("digest").alias("whole"))


@query("""SELECT user_id, event_id, avg(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS average FROM events""")
def throughput(spark, sf_dir):
    """The mean of the last 32 values of each user."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.floor(F.col("value") * 100).cast("bigint").alias("hundredths"))
    return packing.moving_average(rows, "hundredths", "user_id", ["ts", "event_id"]).select("user_id", "event_id", "average")


_FILTER_SQL = "CAST(l_quantity AS INTEGER) * 1024 || ':' || CASE WHEN l_linenumber % 2 = 0 THEN 'zlib' ELSE 'none' END"


@query(f"""WITH f AS (SELECT l_suppkey, {_FILTER_SQL} AS f FROM lineitem), d AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS filter_index FROM (SELECT DISTINCT f FROM f))
SELECT filter_index, f AS filter, count(*) AS rows, count(DISTINCT l_suppkey) AS suppliers FROM f JOIN d USING (f) GROUP BY ALL""")
def filter_dictionary(spark, sf_dir):
    """Filters as a dictionary, rows with its index, and the index resolved."""
    f = F.concat((F.col("l_quantity").cast("int") * 1024).cast("string"), F.lit(":"), F.when(F.col("l_linenumber") % 2 == 0, "zlib").otherwise("none"))
    rows, words = packing.interned(_table(spark, sf_dir, "lineitem").select("l_suppkey", f.alias("filter")), "filter")
    return rows.join(words, "filter_index").groupBy("filter_index", "filter").agg(F.count("*").alias("rows"), F.countDistinct("l_suppkey").alias("suppliers"))


@query(f"""WITH {FILES_SQL}, f AS (SELECT * FROM files WHERE doc_id % 5 <> 2) SELECT 'root' AS call, string_agg(r, ',' ORDER BY r) AS names, 16749 AS mode, CAST(NULL AS BIGINT) AS size FROM (VALUES ('1'), ('2')) AS v(r)
UNION ALL SELECT 'revision', string_agg(DISTINCT source, ',' ORDER BY source), 16749, NULL FROM f UNION ALL SELECT 'file', NULL, 33060, max(size) FROM f WHERE doc_id = 0 UNION ALL SELECT 'blocks', NULL, NULL, CAST(sum(size) // 512 AS BIGINT) FROM f""")
def file_system_calls(spark, sf_dir):
    """A store as a read-only file system: stat, readdir and statfs."""
    store = _kept_store(spark, sf_dir)
    names = lambda path: listing.read_dir(store, path).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))  # noqa: E731  names of one folder
    row = lambda call, df: df.select(F.lit(call).alias("call"), *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("names", "string"), ("mode", "int"), ("size", "bigint"))))
    out = row("root", listing.stat(store, "/").drop("size").join(names("/")))  # one row each
    out = out.unionByName(row("revision", listing.stat(store, "/2").drop("size").join(names("/2"))))
    out = out.unionByName(row("file", listing.stat(store, "/2/src0/0")))
    return out.unionByName(row("blocks", listing.file_system_size(store).withColumnRenamed("blocks", "size")))


@query("SELECT DISTINCT upper(sha1(text)) AS sha1 FROM documents")
def stream_contents(spark, sf_dir):
    """2.9: documents as a stream, each content once."""
    from palimpsest.streaming.ingest import new_contents

    docs = _table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/stream-{scratch(spark.range(1)).inputFiles()[0].rsplit('/', 2)[1]}"
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]").select(F.hex(F.unhex(F.sha1(F.encode("text", "UTF-8")))).alias("sha1"))
    new_contents(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return spark.read.schema("sha1 string").parquet(f"{base}/rows")


@query("SELECT user_id, min(ts) AS first_at, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 1")
def stream_counts(spark, sf_dir):
    """2.9: events as a stream, folded batch by batch into totals of each user."""
    rows = _table(spark, sf_dir, "events")
    base = f"{shared_dir(spark)}/stream-{scratch(spark.range(1)).inputFiles()[0].rsplit('/', 2)[1]}"
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parque[t]").groupBy("user_id").agg(F.min("ts").alias("first_at"), F.count("*").alias("n"))
    save = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
    stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(f"{base}/rows")
    last = done.agg(F.max("batch")).first()[0]  # each batch has all totals so far
    return done.where(F.col("batch") == last).drop("batch")


@query(f"""WITH {FILES_SQL} SELECT source, count(DISTINCT sha1) AS about FROM files GROUP BY source""")
def distinct_estimate(spark, sf_dir):
    """The estimate of distinct contents is within a tenth of their number."""
    files = _files(spark, sf_dir).select("source", "sha1")
    exact = files.groupBy("source").agg(F.countDistinct("sha1").alias("n"))
    both = dedup.estimated_distinct(files, "source").join(exact, "source")
    return both.select("source", F.when(F.abs(F.col("approx_unique") - F.col("n")) <= 0.1 * F.col("n") + 1, F.col("n")).alias("about"))


@query("""SELECT c_custkey, c_acctbal, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_acctbal DESC, c_custkey) AS place FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def sorted_rows(spark, sf_dir):
    """O3-O7 O10 E-7: rows by several keys with ties broken, the first three of each group, and their place."""
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    totals = rows.groupBy("c_nationkey").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("c_nationkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumn("_before", before).select("c_nationkey", "_before")  # a row for each nation
    return rows.withColumn("_i", n).where("_i <= 3").join(F.broadcast(starts), "c_nationkey").select("c_custkey", "c_acctbal", "c_nationkey", (F.col("_i") + F.col("_before")).alias("place"))


@query("SELECT page_id, url, '/' || array_to_string(string_split(url, '/')[4:], '/') AS below, string_split(url, '/')[3] AS host FROM pages")
def url_paths(spark, sf_dir):
    """The path and the host of a url by cutting at separators."""
    u = F.col("url")
    rest = text.drop_up_to(u, "//")
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("/"), text.from_(rest, "/")).alias("below"), text.up_to(rest, "/").alias("host"))
