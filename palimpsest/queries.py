"""Registered queries of the store's operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import digests, meta, paths, text, time
from palimpsest.operators import chunking, dedup, diff, packing, rules
from palimpsest.operators.ids import numbered, scratch
from palimpsest.plans import listing, purge
from palimpsest.plans.restore import assemble, overlapping
from palimpsest.sources.files import document_files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, source, size, sha1 and text of documents as files."""
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "source", F.octet_length("text").cast("bigint").alias("size"), F.sha1(F.encode("text", "UTF-8")).alias("sha1"), "text")


FILES_SQL = "files AS (SELECT doc_id, '/' || source || '/' || doc_id AS path, source, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha1(text) AS sha1, text FROM documents)"


@query(f"""WITH {FILES_SQL}, kept AS (SELECT * FROM files WHERE NOT (contains(path, '/src3/') OR regexp_matches(path, '7$')) OR contains(path, '/src3/1')),
c AS (SELECT source, sha1, count(*) AS n, min(size) AS one FROM kept GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS files, CAST(sum(n * one) AS BIGINT) AS bytes, count(*) AS unique_files, CAST(sum(one) AS BIGINT) AS unique_bytes,
CAST(100 - (100 * sum(one)) // sum(n * one) AS BIGINT) AS saved_pct FROM c GROUP BY source""")
def dedup_report(spark, sf_dir):
    """What exact deduplication saves for each source, after exclude and include rules."""
    files = rules.kept(_files(spark, sf_dir), rules.parse_rules("/src3/\nr/7$\n"), rules.parse_rules("/src3/1"))
    return dedup.storage_report(files.drop("text"), "source")


@query("""SELECT page_id, url, (contains(url, '/fr/') OR regexp_matches(url, 'ref=x$') OR NOT regexp_matches(url, '^https?://')) AND NOT regexp_matches(url, '/[0-9]$') AS excluded,
(contains(url, '/fr/') OR regexp_matches(url, 'ref=x$') OR NOT regexp_matches(url, '^https?://')) AND regexp_matches(url, '/[0-9]$') AS reincluded FROM pages""")
def rule_flags(spark, sf_dir):
    """Exclude and include rules over urls: substring, regular and inverted; a bad pattern matches nothing."""
    exclude = rules.parse_rules("/fr/\nr/ref=x$\nR/^https?://\nr/(unclosed\n\n")
    return rules.mark_excluded(_table(spark, sf_dir, "pages").select("page_id", "url"), exclude, rules.parse_rules("r//[0-9]$"), "url")


@query(f"""WITH {FILES_SQL} SELECT path, source, doc_id FROM files WHERE path LIKE '%7' OR path LIKE '%src1/2' """)
def suffixes(spark, sf_dir):
    """S3-S6 E-2: rows whose name ends in one of some suffixes."""
    return rules.suffix_filter(_files(spark, sf_dir).select("path", "source", "doc_id"), ["7", "src1/2"], name="path")


def _revision(spark, sf_dir, r: int) -> DataFrame:
    files = _files(spark, sf_dir).where(F.col("doc_id") % 5 != r % 5)
    return files.select("path", F.when(F.col("doc_id") % 11 == r, F.concat("text", F.lit(f"#{r}"))).otherwise(F.col("text")).alias("t")).select("path", F.octet_length("t").cast("bigint").alias("size"), F.sha1(F.encode("t", "UTF-8")).alias("sha1"))


def _revision_sql(r: int) -> str:
    return f"r{r} AS (SELECT path, CAST(octet_length(encode(t)) AS BIGINT) AS size, sha1(t) AS sha1 FROM (SELECT path, CASE WHEN doc_id % 11 = {r} THEN text || '#{r}' ELSE text END AS t FROM files WHERE doc_id % 5 <> {r % 5}))"


@query(f"""WITH {FILES_SQL}, {_revision_sql(2)}, {_revision_sql(3)} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.size = b.size AND a.sha1 = b.sha1 THEN 'unchanged' ELSE 'modified' END AS status,
a.size AS old_size, b.size AS new_size FROM r2 a FULL JOIN r3 b ON a.path = b.path""")
def revision_diff(spark, sf_dir):
    """Added, deleted, modified and unchanged paths between two revisions."""
    d = diff.tree_diff(_revision(spark, sf_dir, 2), _revision(spark, sf_dir, 3))
    return d.select("path", "status", F.col("was.size").alias("old_size"), F.col("is.size").alias("new_size"))


@query(f"WITH {FILES_SQL}, {_revision_sql(2)}, {_revision_sql(3)} SELECT path, size, sha1 FROM r2 WHERE path NOT IN (SELECT path FROM r3)")
def deleted(spark, sf_dir):
    """Files of the previous revision that are gone."""
    return diff.deleted_files(_revision(spark, sf_dir, 3), _revision(spark, sf_dir, 2))


def _with_meta(df: DataFrame) -> DataFrame:
    return df.withColumn("meta", F.struct(F.lit("file").alias("type"), "size", F.lit(420).alias("mode"), F.lit(1).alias("uid"), F.lit(1).alias("gid"), F.lit(None).cast("timestamp").alias("ctime"), F.timestamp_seconds(F.col("size")).alias("mtime"), F.lit(None).cast("timestamp").alias("atime"), F.lit(None).cast("string").alias("link_target")))


@query(f"""WITH {FILES_SQL}, {_revision_sql(2)}, {_revision_sql(3)} SELECT b.path, a.path IS NULL OR a.size <> b.size AS is_changed, CASE WHEN a.size = b.size THEN length(b.path) END AS list_id FROM r3 b LEFT JOIN r2 a ON a.path = b.path""")
def change_detection(spark, sf_dir):
    """Files whose metadata differs from the previous revision; the others keep their chunk list."""
    old = _with_meta(_revision(spark, sf_dir, 2)).withColumn("list_id", F.length("path").cast("bigint"))
    return diff.changed_files(_with_meta(_revision(spark, sf_dir, 3)).select("path", "meta"), old).select("path", "is_changed", "list_id")


@query(f"""WITH {FILES_SQL}, {_revision_sql(2)}, {_revision_sql(3)} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'delete' WHEN b.path IS NULL THEN 'write' WHEN a.size = b.size THEN 'skip' WHEN b.size > a.size THEN 'skip' ELSE 'write' END AS action FROM r2 a FULL JOIN r3 b ON a.path = b.path""")
def restore_actions(spark, sf_dir):
    """What restoring revision 2 over revision 3 does to each path."""
    return diff.restore_plan(_with_meta(_revision(spark, sf_dir, 2)), _with_meta(_revision(spark, sf_dir, 3)), "update", delete_extra=True)


@query("SELECT event_id, ts, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20 12:00:00' OR event_id < 0")
def time_range(spark, sf_dir):
    """Rows of a closed time range; the filter reaches the scan."""
    return listing.in_range(_table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", "2024-01-02 00:00:00", "2024-01-20 12:00:00")


@query("SELECT event_type, max(ts) AS at, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY event_type")
def latest_before(spark, sf_dir):
    """The last row of each kind at or before a time, by max_by."""
    events = _table(spark, sf_dir, "events")
    end = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("end"))
    rows = events.join(F.broadcast(end), F.col("ts") <= F.col("end"))  # one row
    return rows.groupBy("event_type").agg(F.max("ts").alias("at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def _refs(spark, sf_dir) -> DataFrame:
    item = _table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_orderkey").alias("list_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("chunk_id"), (F.year("l_shipdate") - 1994).alias("revision"), F.to_date("l_shipdate").alias("d")).distinct()


def _chunks(refs: DataFrame) -> DataFrame:
    first = refs.groupBy("chunk_id").agg(F.min("d").alias("d"))
    return first.select("chunk_id", "d", (F.date_format("d", "yyyyMMdd").cast("bigint") * 4 + F.col("chunk_id") % 4).alias("container_id"))


REFS_SQL = """refs AS (SELECT DISTINCT l_orderkey AS list_id, l_partkey * 1000 + l_suppkey AS chunk_id, CAST(year(l_shipdate) - 1994 AS INTEGER) AS revision, CAST(l_shipdate AS DATE) AS d FROM lineitem),
chunks AS (SELECT chunk_id, min(d) AS d, CAST(strftime(min(d), '%Y%m%d') AS BIGINT) * 4 + chunk_id % 4 AS container_id FROM refs GROUP BY chunk_id)"""


@query(f"WITH {REFS_SQL} SELECT c.container_id, count(*) AS refs, count(DISTINCT r.list_id) AS lists, count(DISTINCT r.chunk_id) AS chunks FROM refs r JOIN chunks c USING (chunk_id) GROUP BY c.container_id")
def resolve_chunks(spark, sf_dir):
    """Lists to chunks to containers."""
    refs = _refs(spark, sf_dir)
    rows = refs.join(_chunks(refs).select("chunk_id", "container_id"), "chunk_id")
    return rows.groupBy("container_id").agg(F.count("*").alias("refs"), F.countDistinct("list_id").alias("lists"), F.countDistinct("chunk_id").alias("chunks"))


@query(f"WITH {REFS_SQL} SELECT chunk_id FROM refs WHERE revision <= 3 EXCEPT SELECT chunk_id FROM refs WHERE revision > 3")
def purge_orphans(spark, sf_dir):
    """Chunks that only purged revisions refer to."""
    return purge.orphans(_refs(spark, sf_dir), 3)


@query(f"WITH {REFS_SQL} SELECT chunk_id FROM refs WHERE revision <= 3 INTERSECT SELECT chunk_id FROM refs WHERE revision > 3")
def purge_keepers(spark, sf_dir):
    """U4: chunks that both sides of the cut refer to."""
    return purge.keepers(_refs(spark, sf_dir), 3)


@query(f"""WITH {REFS_SQL}, dead AS (SELECT chunk_id FROM refs WHERE revision <= 3 EXCEPT SELECT chunk_id FROM refs WHERE revision > 3),
p AS (SELECT container_id, count(*) AS total, count(d.chunk_id) AS removed FROM chunks c LEFT JOIN dead d USING (chunk_id) GROUP BY container_id HAVING count(d.chunk_id) > 0)
SELECT container_id, total, removed, removed / total AS ratio, CASE WHEN removed = total THEN 'drop' WHEN removed / total > 0.4 THEN 'repack' ELSE 'keep' END AS action, row_number() OVER (ORDER BY removed / total DESC, container_id DESC) AS rank FROM p""")
def purge_plan(spark, sf_dir):
    """Containers by the share of dead chunks, with what a purge does to them."""
    refs = _refs(spark, sf_dir)
    return purge.ranked(purge.container_plan(_chunks(refs), purge.orphans(refs, 3), 0.4))


@query(f"WITH {REFS_SQL} SELECT revision, count(*) AS refs, count(DISTINCT chunk_id) AS chunks, CAST(count(DISTINCT CASE WHEN d = f THEN chunk_id END) AS BIGINT) AS new_chunks FROM (SELECT r.revision, r.chunk_id, r.d, c.d AS f FROM refs r JOIN chunks c USING (chunk_id)) GROUP BY revision")
def revision_totals(spark, sf_dir):
    """References, distinct and new chunks of each revision."""
    refs = _refs(spark, sf_dir)
    rows = refs.join(_chunks(refs).select("chunk_id", F.col("d").alias("first")), "chunk_id")
    return rows.groupBy("revision").agg(F.count("*").alias("refs"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct(F.when(F.col("d") == F.col("first"), F.col("chunk_id"))).alias("new_chunks"))


@query(f"WITH {REFS_SQL} SELECT list_id, chunk_id, d, row_number() OVER (PARTITION BY list_id ORDER BY d, chunk_id) - 1 AS pos, CAST(coalesce(sum(chunk_id % 4096 + 22) OVER (PARTITION BY list_id ORDER BY d, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT DISTINCT list_id, chunk_id, d FROM refs)")
def running_offsets(spark, sf_dir):
    """Ordinal and running offset of each chunk in its list."""
    rows = _refs(spark, sf_dir).select("list_id", "chunk_id", "d").distinct().withColumn("size", F.col("chunk_id") % 4096)
    out = packing.running_offset(rows, "list_id", ["d", "chunk_id"])
    return out.withColumn("pos", (F.row_number().over(Window.partitionBy("list_id").orderBy("d", "chunk_id")) - 1).cast("bigint")).drop("size")


ENTROPY_SQL = "b AS (SELECT doc_id, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS x FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, octet_length(encode(text)))) AS i FROM documents)), n AS (SELECT doc_id, x, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS t FROM n GROUP BY doc_id), e AS (SELECT doc_id, round(-sum(n / t * log2(n / t)) / 8, 9) AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id)"


@query(f"WITH {ENTROPY_SQL} SELECT doc_id, coalesce(entropy, 1.0) AS entropy, CASE WHEN coalesce(entropy, 1.0) <= 0.52 THEN 'comp' ELSE 'store' END AS stream FROM documents LEFT JOIN e USING (doc_id)")
def entropy_routing(spark, sf_dir):
    """Entropy of each content and the stream it goes to."""
    e = F.round(digests.entropy(F.encode("text", "UTF-8")), 9)
    return _table(spark, sf_dir, "documents").select("doc_id", e.alias("entropy")).withColumn("stream", packing.route(F.col("entropy"), 0.52))


@query(f"WITH {ENTROPY_SQL} SELECT source, round(min(entropy), 6) AS least, round(avg(entropy), 6) AS mean, round(max(entropy), 6) AS most, count(*) AS n FROM documents JOIN e USING (doc_id) GROUP BY ROLLUP (source)")
def entropy_report(spark, sf_dir):
    """A4: least, mean and greatest entropy of each group and of all, by one rollup."""
    e = F.round(digests.entropy(F.encode("text", "UTF-8")), 9)
    rows = _table(spark, sf_dir, "documents").where("text <> ''").select("source", e.alias("e"))
    return rows.rollup("source").agg(F.round(F.min("e"), 6).alias("least"), F.round(F.avg("e"), 6).alias("mean"), F.round(F.max("e"), 6).alias("most"), F.count("*").alias("n"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha1(text) AS sha1, true AS in_bounds FROM documents WHERE text <> ''")
def chunk_identity(spark, sf_dir):
    """Content-defined chunks add up to the content, by its digest, and keep to the size limits."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    chunks = chunking.chunk_rows(docs)
    last = F.max("offset").over(Window.partitionBy("doc_id"))
    fine = chunks.withColumn("ok", (F.col("size") <= 11299) & ((F.col("size") >= 1856) | (F.col("offset") == last)))
    checks = fine.groupBy("doc_id").agg(F.sum("size").cast("bigint").alias("bytes"), F.bool_and("ok").alias("in_bounds"))
    whole = assemble(chunks.select(F.col("doc_id").cast("string").alias("path"), "pos", "data", F.lit(None).cast("string").alias("error")))
    return checks.join(whole.select(F.col("path").cast("bigint").alias("doc_id"), F.sha1("content").alias("sha1")), "doc_id")


@query(f"""WITH {FILES_SQL}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM files),
p AS (SELECT path, CAST(i AS INTEGER) AS pos, CASE WHEN i < n - 1 THEN t || chr(10) ELSE t END AS data FROM l WHERE i < n - 1 OR t <> '')
SELECT sha1(data) AS sha1, arg_min(path, (path, pos)) AS path, arg_min(pos, (path, pos)) AS pos, CAST(min(octet_length(encode(data))) AS INTEGER) AS size FROM p GROUP BY sha1(data)""")
def first_lines(spark, sf_dir):
    """E-3 J1 U5: line chunks, first writer wins."""
    rows = chunking.chunk_lines(_files(spark, sf_dir).select("path", "text"))
    return dedup.first_occurrences(rows.select("sha1", "path", "pos", "size"))


@query(f"""WITH {FILES_SQL}, old AS (SELECT DISTINCT sha1 FROM files WHERE doc_id % 3 = 0) SELECT doc_id, sha1 FROM files WHERE doc_id % 3 <> 0 AND sha1 NOT IN (SELECT sha1 FROM old)""")
def unknown_contents(spark, sf_dir):
    """Contents that the index doesn't hold yet."""
    files = _files(spark, sf_dir).select("doc_id", "sha1")
    return dedup.unknown(files.where("doc_id % 3 <> 0"), files.where("doc_id % 3 = 0").select("sha1").distinct())


@query(f"""WITH c AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 500) AS BIGINT))) AS pos, text FROM documents WHERE text <> ''), d AS (SELECT doc_id, pos, substr(text, pos * 500 + 1, 500) AS data FROM c),
o AS (SELECT *, octet_length(encode(data)) AS size, coalesce(sum(octet_length(encode(data))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM d)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(o AS BIGINT) AS file_offset, CAST(greatest(1200 - o, 0) AS BIGINT) AS skip, CAST(least(size - greatest(1200 - o, 0), 2000 - o - greatest(1200 - o, 0)) AS BIGINT) AS take FROM o WHERE o < 2000 AND o + size > 1200""")
def byte_range(spark, sf_dir):
    """The parts of fixed-size chunks that a byte range covers."""
    rows = chunking.chunk_fixed(_table(spark, sf_dir, "documents").select("doc_id", "text"), 500)
    out = overlapping(rows.select("doc_id", "pos", "size"), 1200, 800, "doc_id")
    return out.select("doc_id", "pos", "file_offset", F.col("skip").cast("bigint").alias("skip"), F.col("take").cast("bigint").alias("take"))


@query("""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey, p_size FROM part), f AS (SELECT i, p_partkey, CAST(0 AS BIGINT) AS container, CAST(0 AS BIGINT) AS "offset", CAST(p_size + 22 AS BIGINT) AS used FROM p WHERE i = 1
UNION ALL SELECT p.i, p.p_partkey, CASE WHEN f.used + p.p_size + 22 > 700 THEN f.container + 1 ELSE f.container END, CASE WHEN f.used + p.p_size + 22 > 700 THEN 0 ELSE f.used END, CASE WHEN f.used + p.p_size + 22 > 700 THEN 0 ELSE f.used END + p.p_size + 22 FROM f JOIN p ON p.i = f.i + 1)
SELECT p_partkey, container, "offset" FROM f""")
def next_fit(spark, sf_dir):
    """Greedy packing in order, one stream."""
    return packing.next_fit(_table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_partkey"], 700, size="p_size").drop("p_size")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 99 AS BIGINT) AS id FROM orders")
def dense_ids(spark, sf_dir):
    """Dense ids in an order, from range partitions."""
    return numbered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "id", 100).select("o_orderkey", "id")


@query("""SELECT c_custkey, strpos(c_name, '#') - 1 AS found, lower(c_name) AS low, upper(c_mktsegment) AS up, split_part(c_name, '#', 2) AS tail, split_part(c_name, '#', 1) AS head,
CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS n, length(c_name) - length(replace(c_name, '0', '')) AS zeros, CASE WHEN length(c_mktsegment) < 12 THEN rpad(c_mktsegment, 12, '.') ELSE c_mktsegment END AS padded,
right(c_name, 3) AS last3, trim(c_name, 'Cr') AS trimmed, repeat(c_mktsegment, 2) AS twice, replace(c_name, 'Customer', 'C') AS short, reverse(c_name) AS back, octet_length(encode(c_name)) AS bytes, regexp_replace(c_name, '0+', '<0>') AS first_run,
lower(c_name) = lower(upper(c_name)) AS same FROM customer""")
def text_functions(spark, sf_dir):
    """Searching, cutting, padding, trimming, replacing."""
    c = F.col("c_name")
    segment = F.col("c_mktsegment")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", text.find(c, "#").cast("bigint").alias("found"), text.ascii_lower(c).alias("low"), text.ascii_upper(segment).alias("up"), text.from_(c, "#").alias("tail"), text.up_to(c, "#").alias("head"),
        text.to_number(text.from_(c, "#", last=True)).alias("n"), text.count(c, "0").alias("zeros"), text.aligned(segment, 12, "left", ".").alias("padded"), text.mid(c, -3, 3).alias("last3"), text.trim_set(c, "Cr").alias("trimmed"),
        F.repeat(segment, 2).alias("twice"), F.replace(c, F.lit("Customer"), F.lit("C")).alias("short"), F.reverse(c).alias("back"), F.octet_length(c).cast("bigint").alias("bytes"), text.replace_first(c, "0+", "<0>").alias("first_run"), text.caseless_equal(c, F.upper(c)).alias("same"),
    )


@query("""SELECT o_orderkey, CASE WHEN b >= 1048576 THEN (b // 1048576) || '.' || ((b // 1024 % 1024) * 10 // 1024) || 'MB' WHEN b >= 1024 THEN (b // 1024) || '.' || ((b % 1024) * 10 // 1024) || 'KB' ELSE b || '.0B' END AS size,
CASE WHEN b >= 86400000 THEN (b // 86400000) || 'day' WHEN b >= 3600000 THEN (b // 3600000) || 'hour' WHEN b >= 60000 THEN (b // 60000) || 'min' WHEN b >= 1000 THEN (b // 1000) || 'sec' ELSE b || 'ms' END AS took, CAST(100 - 100 * (b // 3) // b AS BIGINT) AS saved
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 13) AS BIGINT) AS b FROM orders)""")
def legible(spark, sf_dir):
    """Sizes and times for people, savings in percent."""
    b = F.floor(F.col("o_totalprice") * 13).cast("bigint")
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.legible_size(b).alias("size"), text.legible_time(b).alias("took"), text.savings(b, F.call_function("div", b, F.lit(3))).alias("saved"))


@query("SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent, regexp_extract(url, '([^/]*)$', 1) AS name, rtrim(url, '/') || '/' AS folder, length(url) - length(replace(url, '/', '')) AS depth, '/a/' || page_id AS normal FROM pages")
def path_functions(spark, sf_dir):
    """Parents, names, separators, dot segments."""
    u = F.col("url")
    dotted = F.concat(F.lit("/../a/./b//../"), F.col("page_id").cast("string"), F.lit("/"))
    return _table(spark, sf_dir, "pages").select("page_id", paths.parent(u).alias("parent"), paths.name(u).alias("name"), paths.with_separator(u, True).alias("folder"), paths.depth(u).cast("bigint").alias("depth"), paths.normalized(dotted).alias("normal"))


@query("""SELECT o_orderkey, 'P1/' || upper(to_hex(o_orderkey)) || '/' || upper(to_hex(m)) || '/' || upper(to_hex(s)) || '/1/3E8/3E8/0/' || upper(to_hex(t)) || '/0' AS packed, CAST(m % 512 AS BIGINT) AS permissions, 'file' AS type, CAST(s AS BIGINT) AS size,
'-' || p[m // 64 % 8 + 1] || p[m // 8 % 8 + 1] || p[m % 8 + 1] || ' ' || rpad('1000:1000', 19, ' ') || ' ' || lpad(CAST(s AS VARCHAR), CAST(greatest(7, length(CAST(s AS VARCHAR))) AS INTEGER), ' ') || ' ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS line
FROM (SELECT *, 32768 + o_orderkey % 512 AS m, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(epoch(o_orderdate) AS BIGINT) AS t, ['---', '--x', '-w-', '-wx', 'r--', 'r-x', 'rw-', 'rwx'] AS p FROM orders)""")
def metadata(spark, sf_dir):
    """Metadata packed as text, parsed back, and printed."""
    m, s, t = 32768 + F.col("o_orderkey") % 512, F.floor("o_totalprice").cast("bigint"), F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    lit = lambda n: F.lit(n).cast("bigint")
    stat = {"dev": lit(1), "ino": F.col("o_orderkey"), "mode": m, "size": s, "nlink": lit(1), "uid": lit(1000), "gid": lit(1000), "ctime": lit(0), "mtime": t, "atime": lit(0)}
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", meta.to_text(stat).alias("packed")).withColumn("x", meta.from_text(F.col("packed")))
    line = meta.pretty(F.struct("x.type", F.col("x.mode").cast("int").alias("mode"), "x.uid", "x.gid", "x.size", F.timestamp_seconds("x.mtime").alias("mtime")))
    return rows.select("o_orderkey", "packed", "x.permissions", "x.type", "x.size", line.alias("line"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS rfc, year(o_orderdate) AS y, CAST(date_diff('week', TIMESTAMP '1970-01-05', o_orderdate) * 0 + floor(epoch(o_orderdate) / 604800) AS BIGINT) AS weeks,
o_orderdate + INTERVAL 36 HOUR AS later, CAST(epoch(o_orderdate) * 1000 AS BIGINT) AS ms, o_orderdate AS back, TIMESTAMP '2024-03-05 00:00:00' AS compact FROM orders""")
def time_functions(spark, sf_dir):
    """Formats, parts, arithmetic, bases; parsing is the inverse of printing."""
    t = F.col("o_orderdate")
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey", time.iso8601(t).alias("iso"), time.rfc1123(t).alias("rfc"), time.parts(t)["year"].cast("bigint").alias("y"), time.between_in(time.epoch(), t, "week").alias("weeks"), time.plus(t, F.lit(36), "hour").cast("timestamp_ntz").alias("later"),
        time.with_base(t, 1000).alias("ms"), time.from_date_text(time.rfc1123(t)).cast("timestamp_ntz").alias("back"), time.parse_compact(F.lit("20240305")).cast("timestamp_ntz").alias("compact"),
    )


@query("SELECT doc_id, sha1(text) AS s1, sha256(text) AS s256, md5(text) AS m, hex(encode(text)) AS h, base64(encode(text)) AS b64, true AS b85 FROM documents")
def digest_functions(spark, sf_dir):
    """Digests and encodings; base 85 by its inverse."""
    b = F.encode("text", "UTF-8")
    return _table(spark, sf_dir, "documents").select("doc_id", digests.sha1(b).alias("s1"), digests.sha256(b).alias("s256"), F.md5(b).alias("m"), F.hex(b).alias("h"), F.translate(F.base64(b), "\r\n", "").alias("b64"), (digests.unbase85(digests.base85(b)) == b).alias("b85"))


@query("""WITH RECURSIVE i AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
p AS (SELECT id, '/' || name AS path, 1 AS depth FROM i WHERE parent IS NULL UNION ALL SELECT i.id, p.path || '/' || i.name, p.depth + 1 FROM i JOIN p ON i.parent = p.id) SELECT id, path, depth FROM p""")
def tree_paths(spark, sf_dir):
    """Full paths from a chain of parents, a join for each level."""
    s = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    items = _table(spark, sf_dir, "region").select(s("r_regionkey", "r").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    items = items.union(_table(spark, sf_dir, "nation").select(s("n_nationkey", "n"), s("n_regionkey", "r"), "n_name")).union(_table(spark, sf_dir, "customer").select(s("c_custkey", "c"), s("c_nationkey", "n"), "c_name"))
    return listing.full_paths(items)


@query(f"WITH {FILES_SQL} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, right(path, 1) AS suffix, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, min(path) AS first_path FROM files GROUP BY ALL")
def entries_count(spark, sf_dir):
    """Entries of each folder by suffix."""
    files = _files(spark, sf_dir).drop("text")
    return files.groupBy(paths.parent(F.col("path")).alias("folder"), F.right("path", F.lit(1)).alias("suffix")).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.min("path").alias("first_path"))


@query("""SELECT page_id, len(a) AS n, a[3] AS host, CAST(coalesce(list_position(a, 'fr'), 0) - 1 AS BIGINT) AS at, list_contains(a, 'en') AS has, array_to_string(a[3:], '/') AS tail, array_to_string(list_reverse(a), '|') AS back, coalesce(a[99], '') AS beyond, coalesce(list_filter(a, lambda x: contains(x, 'page='))[1], '') AS looked_up, len(list_distinct(a)) AS different
FROM (SELECT page_id, string_split(url, '/') AS a FROM pages)""")
def array_functions(spark, sf_dir):
    """String arrays."""
    a = F.col("a")
    return _table(spark, sf_dir, "pages").select("page_id", F.split("url", "/").alias("a")).select(
        "page_id", F.size(a).cast("bigint").alias("n"), F.try_element_at(a, F.lit(3)).alias("host"), (F.array_position(a, "fr") - 1).alias("at"), F.array_contains(a, "en").alias("has"), F.array_join(F.slice(a, F.lit(3), F.size(a)), "/").alias("tail"),
        F.array_join(F.reverse(a), "|").alias("back"), F.coalesce(F.try_element_at(a, F.lit(99)), F.lit("")).alias("beyond"), F.coalesce(F.try_element_at(F.filter(a, lambda x: x.contains("page=")), F.lit(1)), F.lit("")).alias("looked_up"), F.size(F.array_distinct(a)).cast("bigint").alias("different"),
    )


@query("SELECT p_brand, count(*) AS n, arg_min(p_type, p_partkey) AS first_type, CAST(max(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS INTEGER) AS big, arg_min(p_name, p_partkey) AS kept FROM part GROUP BY p_brand")
def map_functions(spark, sf_dir):
    """A hash map's store, look-up and insert-if-absent as grouped and map expressions."""
    rows = _table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.min_by("p_type", "p_partkey").alias("first_type"), F.max((F.col("p_size") > 25).cast("int")).alias("big"), F.min_by("p_name", "p_partkey").alias("name"))
    m = F.map_concat(F.create_map(F.lit("kept"), F.col("name")), F.create_map(F.lit("type"), F.col("first_type")))
    return rows.select("p_brand", "n", F.element_at(m, "type").alias("first_type"), "big", F.when(F.map_contains_key(m, "kept"), F.element_at(m, "kept")).alias("kept"))


@query("SELECT l_returnflag, l_linestatus, max(CAST(split_part(f, ':', 1) AS INTEGER)) AS largest, count(DISTINCT f) AS filters FROM (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) * 1024 || ':' || CASE WHEN l_linenumber % 2 = 0 THEN 'zlib' ELSE 'none' END AS f FROM lineitem) GROUP BY ALL")
def filter_arguments(spark, sf_dir):
    """Container filters as text and the largest size in them."""
    f = F.concat((F.col("l_quantity").cast("int") * 1024).cast("string"), F.lit(":"), F.when(F.col("l_linenumber") % 2 == 0, "zlib").otherwise("none"))
    return _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", f.alias("f")).groupBy("l_returnflag", "l_linestatus").agg(packing.max_container_size(F.col("f")).alias("largest"), F.countDistinct("f").alias("filters"))


@query(f"WITH {FILES_SQL} SELECT path, size, sha1, 2 AS revision FROM files WHERE doc_id % 5 <> 2 UNION ALL SELECT path, size, sha1, 1 FROM files WHERE doc_id % 5 <> 1")
def store_round_trip(spark, sf_dir):
    """Two backups into a store; what is restored is what was saved."""
    from palimpsest.plans.restore import restore

    store = _kept_store(spark, sf_dir)
    out = None
    for r in (1, 2):
        rows = restore(store, r).where("meta.type = 'file'").select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha1("content").alias("sha1"), F.lit(r).alias("revision"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _store(spark, sf_dir):
    from palimpsest.plans.backup import backup
    from palimpsest.store import Store

    base = scratch(spark.range(1), "store").inputFiles()[0].rsplit("/", 1)[0]  # a fresh shared folder
    store = Store(spark, f"{base}/store").create()
    files, by = document_files(_table(spark, sf_dir, "documents")), F.col("name").cast("bigint") % 5
    for r in (1, 2):
        backup(store, files.where(by != r), created_at=f"2024-01-0{r} 00:00:00", buckets=8)
    return store


@query(f"WITH {FILES_SQL} SELECT path, size, sha1 FROM files WHERE doc_id % 5 <> 2")
def store_after_purge(spark, sf_dir):
    """After the first revision is purged and half-dead containers are repacked, the second is whole."""
    from palimpsest.plans.restore import restore

    store = _store(spark, sf_dir)
    purge.purge(store, 1, "slow")
    return restore(store, 1).where("meta.type = 'file'").select("path", F.octet_length("content").cast("bigint").alias("size"), F.sha1("content").alias("sha1"))


@query("SELECT doc_id, true AS zlib, true AS zstd, true AS sealed FROM documents")
def codecs(spark, sf_dir):
    """Decoding inverts encoding, decryption inverts encryption."""
    from palimpsest.sources.sinks import decrypted, encrypted

    def same(codec):
        from pyspark.sql.types import BooleanType

        return F.pandas_udf(lambda s: s.map(lambda b: packing.decode(packing.encode(bytes(b), codec), codec) == bytes(b)), BooleanType())

    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("plain")).withColumn("blob", F.col("plain"))
    rows = decrypted(encrypted(rows, b"0123456789abcdef0123456789abcdef"), b"0123456789abcdef0123456789abcdef")
    return rows.select("doc_id", same("zlib")("plain").alias("zlib"), same("zstd")("plain").alias("zstd"), (F.col("blob") == F.col("plain")).alias("sealed"))


_stores: dict = {}


def _kept_store(spark, sf_dir):
    """One store for all queries that only read it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        _stores[key] = _store(spark, sf_dir)
    return _stores[key]


@query(f"""WITH {FILES_SQL} SELECT CAST(r AS INTEGER) AS revision, CAST('2024-01-01' AS TIMESTAMP) + to_days(r - 1) AS created_at, count(*) FILTER (is_new) AS file_count, count(DISTINCT source) AS dir_count,
CAST(sum(CASE WHEN is_new THEN size ELSE 0 END) AS BIGINT) AS ingested_bytes, CAST(sum(size) AS BIGINT) AS total_bytes FROM (SELECT *, 1 AS r, true AS is_new FROM files WHERE doc_id % 5 <> 1 UNION ALL SELECT *, 2, doc_id % 5 = 1 FROM files WHERE doc_id % 5 <> 2) GROUP BY r""")
def store_revisions(spark, sf_dir):
    """Revisions with their totals, newest first."""
    rows = listing.list_revisions(_kept_store(spark, sf_dir), end="2024-02-01 00:00:00")
    return rows.select("revision", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "file_count", "dir_count", "ingested_bytes", "total_bytes")


@query(f"""WITH {FILES_SQL}, t AS (SELECT path, '-rw-r--r--' AS mode, size FROM files WHERE doc_id % 5 <> 2 UNION ALL SELECT DISTINCT '/' || source, 'd?????????', 0 FROM files WHERE doc_id % 5 <> 2)
SELECT path, row_number() OVER (ORDER BY path) AS item_id, left(mode, 1) AS kind, CAST(size AS BIGINT) AS size FROM t""")
def store_files(spark, sf_dir):
    """Items of a revision in order of path, with dense ids."""
    store = _kept_store(spark, sf_dir)
    sizes = store.tree(2).select("item_id", F.col("meta.size").alias("size"))
    return listing.list_files(store, 2).select("path", "item_id", F.left("line", F.lit(1)).alias("kind")).join(sizes, "item_id").select("path", "item_id", "kind", "size")


@query(f"WITH {FILES_SQL} SELECT CAST(doc_id AS VARCHAR) AS name, path, size FROM files WHERE source = 'src3' AND doc_id % 5 <> 1")
def store_folder(spark, sf_dir):
    """Children of one folder."""
    return listing.list_dir(_kept_store(spark, sf_dir), 1, "/src3").select("name", "path", F.col("meta.size").alias("size"))


@query(f"WITH {FILES_SQL} SELECT path, sha1(text) AS whole FROM files WHERE doc_id = 0")
def store_cat(spark, sf_dir):
    """One file by its path."""
    from palimpsest.plans.restore import cat

    return cat(_kept_store(spark, sf_dir), "/src0/0", 2).select("path", F.sha1("content").alias("whole"))


@query("SELECT lower(substr(hex(encode(text)), 2 * 1800 + 1, 2 * 900)) AS part FROM documents WHERE doc_id = 0")
def store_range(spark, sf_dir):
    """A byte range across chunks, reading only the chunks that it covers."""
    from palimpsest.plans.restore import read_range

    return read_range(_kept_store(spark, sf_dir), "/src0/0", 1, 1800, 900).select(F.lower(F.hex("content")).alias("part"))


@query(f"""WITH {FILES_SQL}, f AS (SELECT * FROM files WHERE doc_id % 5 <> 1) SELECT CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT CASE WHEN size > 0 THEN path END) AS files, true AS no_larger, true AS all_found FROM f""")
def store_relations(spark, sf_dir):
    """Lists, chunks and containers of a revision agree with one another and with the files."""
    from palimpsest.operators.packing import open_containers

    d = listing.dump(_kept_store(spark, sf_dir), 1)
    refs = d["file_tree"].select("path", "list_id").join(d["chunk_lists"], "list_id").join(d["chunks"].select("chunk_id", "size", "container_id", "sha1"), "chunk_id")
    opened = open_containers(d["containers"]).select("container_id", "sha1", F.sha1("data").alias("again"))
    found = refs.join(opened, ["container_id", "sha1"], "left")
    totals = found.agg(F.sum("size").cast("bigint").alias("bytes"), F.countDistinct("path").alias("files"), F.bool_and(F.lower(F.hex("sha1")) == F.col("again")).alias("all_found"))
    return totals.join(d["containers"].agg(F.bool_and(F.col("raw_size") <= packing.MOST).alias("no_larger")))  # two rows of totals


from palimpsest import function_queries  # noqa: E402, F401  (registers the rest)
