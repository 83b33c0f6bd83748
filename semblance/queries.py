"""The library's queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formatting, hashing
from .operators import catalog, exact, feedback, prefix, signatures, similarity, store
from .plans import deletion, render
from .session import kept
from .sources.tables import document_files, hashed_files, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL that several queries begin with
FILES = """files AS (
  SELECT doc_id AS file_id, '/' || source || '/' || lang AS dir, doc_id::VARCHAR AS name, text, octet_length(encode(text))::BIGINT AS size, sha1(text) AS fullsha1
  FROM documents WHERE octet_length(encode(text)) >= 1024
), hashed AS (SELECT *, min(file_id) OVER (PARTITION BY fullsha1) AS contentid, dir || '/' || name AS path FROM files)"""
# Cutting bytes in SQL: hex digits of the bytes, two for each.
FIRST_KIB = "sha1(unhex(substr(hex(encode(text)), 1, 2048)))"
SIGNED = """points AS (
  SELECT doc_id AS id, list_transform(range(64), lambda i: ascii(substr(text, (i * length(text) // 64 + 1)::BIGINT, 1))) AS v FROM documents WHERE length(text) >= 64
), bits AS (
  SELECT id, array_to_string(list_transform(v, lambda x: CASE WHEN x * 64 >= list_sum(v) THEN '1' ELSE '0' END), '') AS b FROM points
), close AS (
  SELECT x.id AS id, y.id AS other, bit_count(xor(x.b::BIT, y.b::BIT))::INT AS distance FROM bits x JOIN bits y ON x.id <> y.id
)"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _files(spark, sf_dir) -> DataFrame:
    return hashed_files(document_files(spark, sf_dir))


def _signed(spark, sf_dir) -> DataFrame:
    found = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), signatures.text_signature("text").alias("h"))
    rows, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(rows, "1000")  # texts are long: of as many as usual, a batch is too large
    try:
        return kept(found.where("h is not null"))  # every text is read once
    finally:
        spark.conf.set(rows, before)


def _histograms(spark, sf_dir, channels: int = 1) -> DataFrame:
    """Gray: 16 bins of 8 bits from each 4 components' squares; colour: three such from thirds of the vector."""
    v = F.col("embedding")
    if channels == 1:
        bins = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: _bin(v, i * 4, 4, 512))
    else:
        bins = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: _bin(v, i, 4, 256))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bins.alias("h"))


def _bin(v, at, n, scale):
    total = F.aggregate(F.slice(v, at + 1, F.lit(n)), F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    return F.least(F.floor(total * scale), F.lit(255)).cast("int")


def _sql_histograms(channels: int) -> str:
    at, n, scale = ("i * 4", 16, 512) if channels == 1 else ("i", 48, 256)
    return f"""hist AS (SELECT vec_id AS id, list_transform(range({n}), lambda i: least(floor((abs(embedding[{at} + 1]::DOUBLE) + abs(embedding[{at} + 2]::DOUBLE) + abs(embedding[{at} + 3]::DOUBLE) + abs(embedding[{at} + 4]::DOUBLE)) * {scale}), 255)::INT) AS h FROM embeddings
), close AS (
  SELECT id, other, {'(100 * s // 4096)' if channels == 1 else '(100 * (s // 3) // 4096)'}::INT AS distance FROM (
    SELECT x.id AS id, y.id AS other, list_sum(list_transform(list_zip(x.h, y.h), lambda p: abs(p[1] - p[2])))::BIGINT AS s FROM hist x JOIN hist y ON x.id <> y.id)
)"""


# ---- bit-equal files


@query(f"""WITH {FILES}, many AS (SELECT contentid, any_value(size) AS size FROM hashed GROUP BY 1 HAVING count(*) > 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, contentid) - 1 AS ctxt_index, count(*) OVER () AS ctxt_size FROM many),
rows AS (SELECT contentid, path, row_number() OVER (PARTITION BY contentid ORDER BY dir, name) AS rn FROM hashed)
SELECT contentid, r.size, false AS hardlinked, a.path AS path1, b.path AS path2, ctxt_index, ctxt_size, row_number() OVER (PARTITION BY contentid ORDER BY a.rn, b.rn) - 1 AS ctxt_subindex
FROM rows a JOIN rows b USING (contentid) JOIN ranked r USING (contentid) WHERE a.rn < b.rn""")
def dup_pairs(spark, sf_dir):
    return exact.equal_pairs(_files(spark, sf_dir))


@query(f"""WITH {FILES}, made AS (SELECT contentid, any_value(size) AS size, count(*) AS n_files, string_agg(path, '|' ORDER BY dir, name) AS files FROM hashed GROUP BY 1 HAVING count(*) > 1)
SELECT *, row_number() OVER (ORDER BY size DESC, contentid) = 1 AS is_first FROM made""")
def dup_buckets(spark, sf_dir):
    return exact.equal_buckets(_files(spark, sf_dir)).withColumn("files", F.array_join("files", "|"))


@query(f"""WITH {FILES}, kept AS (SELECT contentid, arg_min(path, (dir, name)) AS keeper FROM hashed GROUP BY 1 HAVING count(*) > 1)
SELECT path, contentid, keeper FROM hashed JOIN kept USING (contentid)""")
def dup_classes(spark, sf_dir):
    return exact.equal_classes(_files(spark, sf_dir))


LINKED = "CASE WHEN file_id % 3 = 0 THEN file_id ELSE contentid + 1000000000 END"


def _linked(spark, sf_dir) -> DataFrame:
    """Files of one content share an inode, but for every third file."""
    return _files(spark, sf_dir).withColumn("inode", F.when(F.col("file_id") % 3 == 0, F.col("file_id")).otherwise(F.col("contentid") + 1_000_000_000))


@query(f"""WITH {FILES}, linked AS (SELECT *, {LINKED} AS inode FROM hashed)
SELECT a.contentid, a.inode = b.inode AS hardlinked, a.path AS path1, b.path AS path2 FROM linked a JOIN linked b ON a.contentid = b.contentid AND (a.dir, a.name) < (b.dir, b.name)""")
def hard_link_pairs(spark, sf_dir):
    return exact.equal_pairs(_linked(spark, sf_dir)).select("contentid", "hardlinked", "path1", "path2")


@query(f"""WITH {FILES}, linked AS (SELECT *, {LINKED} AS inode FROM hashed), firsts AS (SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY contentid, inode ORDER BY dir, name) = 1)
SELECT contentid, count(*) AS n_files, string_agg(path, '|' ORDER BY dir, name) AS files FROM firsts GROUP BY 1 HAVING count(*) > 1""")
def hard_link_buckets(spark, sf_dir):
    return exact.equal_buckets(_linked(spark, sf_dir)).select("contentid", "n_files", F.array_join("files", "|").alias("files"))


@query(f"""WITH {FILES}, linked AS (SELECT *, {LINKED} AS inode FROM hashed), kept AS (SELECT contentid, arg_min(path, (dir, name)) AS keeper, arg_min(inode, (dir, name)) AS keep_inode FROM linked GROUP BY 1 HAVING count(*) > 1)
SELECT path, contentid, CASE WHEN path = keeper OR inode = keep_inode THEN 'keep' ELSE 'delete' END AS action FROM linked JOIN kept USING (contentid)""")
def hard_link_plan(spark, sf_dir):
    return deletion.deletion_plan(_linked(spark, sf_dir)).select("path", "contentid", "action")


@query(f"""WITH {FILES}, n AS (SELECT *, count(*) OVER (PARTITION BY contentid) AS n, file_id % 2 = 0 AS stays FROM hashed), g AS (SELECT contentid, bool_or(stays) AS any_stays, arg_min(path, (dir, name)) AS keeper FROM n GROUP BY 1)
SELECT path, contentid, CASE WHEN stays OR (NOT any_stays AND path = keeper) THEN 'keep' ELSE 'delete' END AS action FROM n JOIN g USING (contentid) WHERE n > 1""")
def decided_plan(spark, sf_dir):
    """Files of even ids are decided to be kept, all others to go."""
    files = _files(spark, sf_dir)
    decisions = files.select(F.concat_ws("/", "dir", "name").alias("path"), F.when(F.col("file_id") % 2 == 0, "keep").otherwise("delete").alias("action"))
    return deletion.decided_plan(files, decisions).select("path", "contentid", "action")


@query(f"""WITH {FILES}, many AS (SELECT count(*) AS n, any_value(size) AS size FROM hashed GROUP BY contentid HAVING count(*) > 1)
SELECT count(*) AS contents, sum(n - 1)::BIGINT AS extra_files, sum((n - 1) * size)::BIGINT AS wasted_bytes FROM many""")
def dup_wasted_bytes(spark, sf_dir):
    return exact.wasted_bytes(_files(spark, sf_dir))


@query(f"""WITH {FILES}, kept AS (SELECT contentid, min((dir, name)) AS at, arg_min(path, (dir, name)) AS keeper FROM hashed GROUP BY 1 HAVING count(*) > 1)
SELECT path, contentid, CASE WHEN path = keeper THEN 'keep' ELSE 'delete' END AS action, CASE WHEN path = keeper THEN 'chosen' ELSE 'same content as ' || keeper END AS reason FROM hashed JOIN kept USING (contentid)""")
def deletion_plan(spark, sf_dir):
    return deletion.deletion_plan(_files(spark, sf_dir))


@query(f"""WITH {FILES}, rows AS (SELECT contentid, size, path, row_number() OVER (PARTITION BY contentid ORDER BY dir, name) AS rn FROM hashed)
SELECT a.size || ';False;' || a.path || ';' || b.path AS line FROM rows a JOIN rows b USING (contentid) WHERE a.rn < b.rn""")
def dup_pairs_csv(spark, sf_dir):
    return render.equal_pairs_csv(exact.equal_pairs(_files(spark, sf_dir)))


@query(f"""WITH {FILES} SELECT '{{"size":' || any_value(size) || ',"num_files":' || count(*) || ',"files":["' || string_agg(path, '","' ORDER BY dir, name) || '"]}}' AS item FROM hashed GROUP BY contentid HAVING count(*) > 1""")
def dup_buckets_json(spark, sf_dir):
    return render.bucket_json(exact.equal_buckets(_files(spark, sf_dir)))


@query(f"""WITH {FILES}, roots AS (SELECT unnest(['/src1', '/src2/en', '/src3/']) AS root)
SELECT path, contentid FROM hashed WHERE EXISTS (SELECT 1 FROM roots WHERE path = rtrim(root, '/') OR starts_with(path, rtrim(root, '/') || '/'))""")
def root_filter(spark, sf_dir):
    path = F.concat_ws("/", "dir", "name")
    return _files(spark, sf_dir).select(path.alias("path"), "contentid").where(catalog.under_roots(F.col("path"), ["/src1", "/src2/en", "/src3/"]))


@query(f"WITH {FILES} SELECT path FROM hashed WHERE file_id IN (SELECT doc_id FROM labels)")
def existing_files(spark, sf_dir):
    files = _files(spark, sf_dir).select(F.concat_ws("/", "dir", "name").alias("path"), F.col("file_id").alias("doc_id"))
    return catalog.still_there(files, table(spark, sf_dir, "labels"), ["doc_id"]).select("path")


# ---- contents and hashes


@query(f"""WITH {FILES}, c AS (SELECT contentid AS id, any_value(fullsha1) AS fullsha1, any_value(size) AS size, any_value(text) AS text, count(*) AS n_files FROM hashed GROUP BY contentid)
SELECT id, fullsha1, size, {FIRST_KIB} AS first1ksha1, n_files FROM c""")
def content_catalog(spark, sf_dir):
    files = document_files(spark, sf_dir)
    indexed = files.select("file_id", "size", hashing.full_sha1(F.col("content")).alias("fullsha1"), hashing.first1k_sha1(F.col("content")).alias("first1ksha1"))
    return catalog.contents_of(indexed).select("id", "fullsha1", "size", "first1ksha1", "n_files")


@query(f"""WITH f AS (SELECT text FROM documents UNION SELECT substr(text, 1, length(text) // 2) FROM documents)
SELECT {FIRST_KIB} AS first1ksha1, count(*) AS n FROM f WHERE octet_length(encode(text)) >= 1024 GROUP BY 1 HAVING count(*) > 1""")
def first1k_groups(spark, sf_dir):
    files = _with_halves(spark, sf_dir).select(hashing.first1k_sha1(F.col("content")).alias("first1ksha1"), hashing.full_sha1(F.col("content")).alias("fullsha1")).distinct()
    return files.groupBy("first1ksha1").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH f AS (SELECT doc_id, text, hex(encode(text)) AS x, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) >= 1024)
SELECT doc_id AS file_id, sha1(text) AS fullsha1, sha1(unhex(substr(x, 1, 2048))) AS first1ksha1, sha1(unhex(substr(x, 201, 400))) AS middle,
  array_to_string(list_transform(list_filter(range(11, 31), lambda k: (1 << k) < size), lambda k: (1 << k)::VARCHAR || ':' || sha1(unhex(substr(x, 1, 2 * (1 << k))))), ' ') AS parts FROM f""")
def prefix_hashes(spark, sf_dir):
    from .schema import parts_to_text

    c = F.col("content")
    return document_files(spark, sf_dir).select("file_id", hashing.full_sha1(c).alias("fullsha1"), hashing.first1k_sha1(c).alias("first1ksha1"), hashing.range_sha1(c, 100, 200).alias("middle"), parts_to_text(hashing.prefix_sha1s(c)).alias("parts"))


def _with_halves(spark, sf_dir) -> DataFrame:
    """Documents as files, and of each its first half as another file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    whole = docs.select((F.col("doc_id") * 2).alias("file_id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"), F.col("doc_id").cast("string").alias("name"), "text")
    half = whole.select((F.col("file_id") + 1).alias("file_id"), "dir", F.concat("name", F.lit(".part")).alias("name"), F.substr("text", F.lit(1), F.floor(F.char_length("text") / 2).cast("int")).alias("text"))
    both = whole.unionByName(half).withColumn("content", F.col("text").cast("binary"))
    return both.withColumns({"size": F.octet_length("content").cast("long"), "fullsha1": hashing.full_sha1(F.col("content"))}).where("size >= 1024")


@query(f"""WITH f AS (
  SELECT doc_id * 2 AS file_id, '/' || source || '/' || lang AS dir, doc_id::VARCHAR AS name, text FROM documents
  UNION ALL SELECT doc_id * 2 + 1, '/' || source || '/' || lang, doc_id || '.part', substr(text, 1, length(text) // 2) FROM documents
), h AS (SELECT *, octet_length(encode(text))::BIGINT AS size, {FIRST_KIB} AS k, min(file_id) OVER (PARTITION BY text) AS cid, dir || '/' || name AS path FROM f WHERE octet_length(encode(text)) >= 1024
), c AS (SELECT DISTINCT cid, text, size, k FROM h
), g AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS ctxt_index, count(*) OVER () AS ctxt_size FROM (SELECT k FROM c GROUP BY k HAVING count(*) > 1)
), p AS (SELECT l.k, l.cid AS large_id, s.cid AS small_id, l.size AS large_size, s.size AS small_size FROM c l JOIN c s ON l.k = s.k AND l.size > s.size AND starts_with(l.text, s.text))
SELECT large_size, a.path AS large_path, small_size, b.path AS small_path, ctxt_index, ctxt_size,
  row_number() OVER (PARTITION BY p.k ORDER BY large_size DESC, large_id, small_size DESC, small_id, a.dir, a.name, b.dir, b.name) - 1 AS ctxt_subindex
FROM p JOIN h a ON a.cid = large_id JOIN h b ON b.cid = small_id JOIN g ON g.k = p.k""")
def truncated_pairs(spark, sf_dir):
    files = _with_halves(spark, sf_dir)
    ids = files.groupBy("fullsha1").agg(F.min("file_id").alias("contentid"))
    named = files.join(ids, "fullsha1")
    contents = named.where("file_id = contentid").select(F.col("contentid").alias("id"), "size", "fullsha1", hashing.first1k_sha1(F.col("content")).alias("first1ksha1"), hashing.prefix_sha1s(F.col("content")).alias("parts"), "content")
    return prefix.truncated_pairs(contents, named.select("contentid", "dir", "name"))


@query("SELECT page_id, NULL::VARCHAR AS kind, 'gif' AS gif_kind, 'png' AS png_kind FROM pages")
def image_sniff(spark, sf_dir):
    """The pages themselves, and behind a GIF and a PNG magic."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    kind = lambda magic: hashing.image_kind(F.concat(F.unhex(F.lit(magic)), html))
    return table(spark, sf_dir, "pages").select("page_id", kind("").alias("kind"), kind("474946383961").alias("gif_kind"), kind("89504E470D0A1A0A").alias("png_kind"))


# ---- incremental catalog

OLD, NEW = "o_orderstatus <> 'O'", "o_orderpriority <> '1-URGENT'"
STATES = f"""states AS (
  SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'deleted' WHEN a.m = b.m THEN 'unchanged' ELSE 'changed' END AS state
  FROM (SELECT o_orderkey AS k, 1 AS m FROM orders WHERE {OLD}) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '2-HIGH' THEN 2 ELSE 1 END AS m FROM orders WHERE {NEW}) b ON a.k = b.k)"""


def _states(spark, sf_dir) -> DataFrame:
    """Two snapshots of orders: closed ones, and then all but the urgent ones, of which the high ones have changed."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where(OLD).select("o_orderkey", F.lit(1).alias("mtime"))
    new = orders.where(NEW).select("o_orderkey", F.when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1).alias("mtime"))
    return catalog.classify(old, new, ["o_orderkey"])


@query(f"WITH {STATES} SELECT * FROM states")
def snapshot_diff(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"""WITH {STATES}, l AS (
  SELECT o_orderkey, '/' || lower(o_orderstatus) AS dir, o_orderpriority AS name, floor(o_totalprice)::BIGINT AS size, o_orderdate >= TIMESTAMP '1993-01-01' AS regular, o_totalprice < 0 AS failed FROM orders WHERE {NEW}
), k AS (SELECT *, CASE WHEN dir = '/p' THEN 'dir' WHEN name LIKE '5-%' THEN 'name' WHEN NOT regular THEN 'special' WHEN size < 1024 THEN 'small' WHEN failed THEN 'error' ELSE state END AS kind FROM l LEFT JOIN states USING (o_orderkey)
), c AS (SELECT count(DISTINCT CASE WHEN kind <> 'dir' THEN dir END) AS visited_dirs, count(*) FILTER (kind = 'dir') AS skipped_by_dir, count(*) FILTER (kind = 'name') AS skipped_by_name, count(*) FILTER (kind = 'special') AS not_regular,
  count(*) FILTER (kind = 'small') AS too_small, count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind = 'new') AS new, count(*) FILTER (kind = 'changed') AS modified, count(*) FILTER (kind = 'error') AS read_errors,
  coalesce(sum(size) FILTER (kind IN ('new', 'changed')), 0)::BIGINT AS hashed_bytes, coalesce(sum(size) FILTER (kind = 'unchanged'), 0)::BIGINT AS examined_bytes FROM k)
SELECT *, (SELECT count(*) FROM states WHERE state = 'deleted') AS deleted, hashed_bytes + examined_bytes AS known_bytes FROM c""")
def index_counters(spark, sf_dir):
    listing = table(spark, sf_dir, "orders").where(NEW).select(
        "o_orderkey", F.concat(F.lit("/"), F.lower("o_orderstatus")).alias("dir"), F.col("o_orderpriority").alias("name"), F.floor("o_totalprice").alias("size"),
        (F.col("o_orderdate") >= F.lit("1993-01-01").cast("timestamp")).alias("regular"), (F.col("o_totalprice") < 0).alias("failed"),
    )
    return catalog.index_counters(listing, _states(spark, sf_dir), ["o_orderkey"], ["5-*"], ["p"])


@query(r"""SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages WHERE NOT regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^(.*\.html|[0-9]1.*|.*\?page=.*)$')""")
def name_excludes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("url", r"([^/]*)$", 1).alias("name"))
    return catalog.exclude_names(pages, "name", formatting.split_patterns(["*.html,[0-9]1*"], ".git,CVS,RCS") + ["*[?]page=*"])


@query("""WITH known AS (SELECT row_number() OVER (ORDER BY n_name) AS id, n_name AS name FROM nation), new AS (SELECT DISTINCT source AS name FROM documents UNION SELECT r_name FROM region),
missing AS (SELECT name FROM new WHERE name NOT IN (SELECT name FROM known)) SELECT id::BIGINT AS id, name FROM known UNION ALL SELECT row_number() OVER (ORDER BY name) + (SELECT max(id) FROM known), name FROM missing""")
def get_or_insert_dirs(spark, sf_dir):
    from .operators.ranking import with_global_rank

    known = with_global_rank(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), [F.col("name")], "r").select((F.col("r") + 1).alias("id"), "name")
    new = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return store.get_or_insert(known, new, "name").select(F.col("id").cast("long").alias("id"), "name")


# ---- finding rows


@query("""SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 3, 5, 7)""")
def repo_find_eq_in_sort(spark, sf_dir):
    found = store.find(table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_nationkey=store.In([1, 3, 5, 7]))
    from .operators.ranking import with_global_rank

    return with_global_rank(found, [F.desc("c_acctbal"), F.asc("c_custkey")], "r").select("c_custkey", "c_name", (F.col("r") + 1).alias("place"))


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL""")
def repo_find_null(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return store.find(joined, quality=store.Null).select("doc_id")


@query("""SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30""")
def repo_referenced_at_least(spark, sf_dir):
    return store.referenced_at_least(table(spark, sf_dir, "lineitem"), "l_partkey", 30)


@query("""SELECT source AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def unique_violations(spark, sf_dir):
    return store.violations(table(spark, sf_dir, "documents").select(F.col("source").alias("name")), "dir").select("name", F.col("count").alias("n"))


# ---- similarity


@query(f"WITH {SIGNED} SELECT id AS id1, other AS id2, distance FROM close WHERE id < other AND distance <= 6")
def hamming_pairs(spark, sf_dir):
    return similarity.similar_pairs(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.9, 3))


HAMMING_COUNTS = f"""WITH {SIGNED}, counts AS (SELECT id, distance, count(*) AS n FROM close WHERE distance <= 12 GROUP BY 1, 2),
scored AS (SELECT id, sum(least(n, 255) * (80 - 5 * distance))::BIGINT AS score, sum(n)::BIGINT AS total, string_agg(distance || '=' || n, ',' ORDER BY distance) AS counts FROM counts GROUP BY 1),
"""
BEST = "top AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT {})"
#: Centres of a comparison, as many as the library's default; a report of the best ones has fewer.
HAMMING_SCORES = HAMMING_COUNTS + BEST.format(10_000)


@query(f"{HAMMING_COUNTS}{BEST.format(100)} SELECT * FROM top")
def hamming_scores_topk(spark, sf_dir):
    rows = _signed(spark, sf_dir)
    counts = similarity.counted_neighbours(rows, "hamming", formatting.max_distance(0.8, 3))
    top = similarity.top_centres(rows, similarity.scores(counts, similarity.HAMMING_FACTORS), 100)
    return top.select("id", "score", "total", _counts_text().alias("counts"))


def _counts_text():
    return F.array_join(F.transform("counts", lambda c: F.concat(c["distance"].cast("string"), F.lit("="), c["count"].cast("string"))), ",")


def _pairs_text():
    return F.array_join(F.transform("pairs", lambda p: F.concat(p["contentid"].cast("string"), F.lit(":"), p["distance"].cast("string"))), " ")


@query(f"{HAMMING_SCORES} SELECT top.id, any_value(score) AS score, string_agg(other || ':' || distance, ' ' ORDER BY other) AS pairs FROM top JOIN close ON close.id = top.id AND distance <= 12 GROUP BY 1")
def hamming_neighbors(spark, sf_dir):
    found = similarity.compare(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.8, 3), similarity.HAMMING_FACTORS)
    return found.select("id", "score", _pairs_text().alias("pairs"))


@query(f"WITH {_sql_histograms(1)} SELECT id AS id1, other AS id2, distance FROM close WHERE id < other AND distance < 9")
def histogram_pairs_gray(spark, sf_dir):
    return similarity.similar_pairs(_histograms(spark, sf_dir), "histogram", formatting.max_distance(0.9, 1))


@query(f"WITH {_sql_histograms(3)} SELECT id AS id1, other AS id2, distance FROM close WHERE id < other AND distance < 9")
def histogram_pairs_rgb(spark, sf_dir):
    return similarity.similar_pairs(_histograms(spark, sf_dir, 3), "histogram", formatting.max_distance(0.9, 1))


@query(f"""WITH {_sql_histograms(1)}, counts AS (SELECT id, distance, count(*) AS n FROM close WHERE distance < 9 GROUP BY 1, 2)
SELECT id, sum(least(n, 255) * (40 - distance))::BIGINT AS score, sum(n)::BIGINT AS total FROM counts GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def histogram_scores_topk(spark, sf_dir):
    rows = _histograms(spark, sf_dir).where("h is not null")
    counts = similarity.counted_neighbours(rows, "histogram", formatting.max_distance(0.9, 1))
    return similarity.top_centres(rows, similarity.scores(counts, similarity.HISTOGRAM_FACTORS), 50).select("id", "score", "total")


PATHS = "paths AS (SELECT doc_id AS contentid, '/' || source || '/' || lang || '/' || doc_id AS path FROM documents)"


def _paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("contentid"), F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("dir"), F.col("doc_id").cast("string").alias("name"))


@query(f"""{HAMMING_SCORES}, {PATHS}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS ctxt_index, count(*) OVER () AS ctxt_size FROM top)
SELECT top.id AS content_id1, other AS content_id2, score, 1 - distance / 64.0::DOUBLE AS similarity, a.path AS path1, b.path AS path2, ctxt_index, ctxt_size
FROM ranked top JOIN close ON close.id = top.id AND distance <= 6 JOIN paths a ON a.contentid = top.id JOIN paths b ON b.contentid = other""")
def similar_pairs_paths(spark, sf_dir):
    found = similarity.compare(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.8, 3), similarity.HAMMING_FACTORS, listed=formatting.max_distance(0.9, 3))
    return similarity.with_paths(found, _paths(spark, sf_dir), 64.0, 0.9)


@query(f"""{HAMMING_SCORES}, {PATHS} SELECT top.id, any_value(score) AS score, any_value(a.path) AS center, string_agg(other || '=' || b.path, ' ' ORDER BY other) AS others
FROM top JOIN close ON close.id = top.id AND distance <= 6 JOIN paths a ON a.contentid = top.id JOIN paths b ON b.contentid = other GROUP BY 1""")
def similar_buckets(spark, sf_dir):
    found = similarity.compare(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.8, 3), similarity.HAMMING_FACTORS, listed=formatting.max_distance(0.9, 3))
    made = similarity.with_paths(found, _paths(spark, sf_dir), 64.0, 0.9, all_paths=True)
    others = F.array_join(F.transform("others", lambda o: F.concat(o["contentid"].cast("string"), F.lit("="), F.array_join(o["paths"], "|"))), " ")
    return made.select("id", "score", F.array_join("center", "|").alias("center"), others.alias("others"))


@query(f"""{HAMMING_SCORES}, listed AS (SELECT top.id, count(*) AS listed FROM top JOIN close ON close.id = top.id AND distance <= 12 GROUP BY 1)
SELECT top.id, total AS numpairs, listed, total = listed AS consistent FROM top JOIN listed USING (id)""")
def listed_counts(spark, sf_dir):
    return similarity.listed_counts(similarity.compare(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.8, 3), similarity.HAMMING_FACTORS))


# ---- signatures still to make, feedback


@query("""WITH k AS (SELECT doc_id AS contentid, unnest([1, 3]) AS iht FROM documents WHERE lang = 'en')
SELECT contentid, iht FROM k WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = k.contentid AND k.iht = CASE WHEN quality = 1 THEN 3 ELSE 1 END)""")
def new_images(spark, sf_dir):
    contents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("isimage"))
    hashes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("contentid"), F.when(F.col("quality") == 1, 3).otherwise(1).alias("iht"), F.lit("0").alias("hash"))
    return signatures.missing_signatures(contents, hashes, [1, 3])


@query("""WITH cur AS (SELECT doc_id AS a, doc_id + 1 AS b, quality AS s, -1 AS seq, false AS deleted FROM labels), ch AS (SELECT user_id AS a, user_id + 1 AS b, CASE WHEN value > 50 THEN 1 ELSE 0 END AS s, event_id AS seq, event_type = 'error' AS deleted FROM events),
last AS (SELECT a, b, arg_max(s, seq) AS s, arg_max(deleted, seq) AS deleted FROM (SELECT * FROM cur UNION ALL SELECT * FROM ch) GROUP BY 1, 2) SELECT a AS contentid1, b AS contentid2, s AS aresimilar FROM last WHERE NOT deleted""")
def feedback_upsert(spark, sf_dir):
    current = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("contentid1"), (F.col("doc_id") + 1).alias("contentid2"), F.col("quality").alias("aresimilar"))
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("contentid1"), (F.col("user_id") + 1).alias("contentid2"), F.when(F.col("value") > 50, 1).otherwise(0).alias("aresimilar"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"))
    return feedback.upsert_feedback(current, changes)


@query(f"""WITH {SIGNED}, found AS (SELECT id AS a, other AS b FROM close WHERE id < other AND distance <= 12), l AS (SELECT doc_id, quality FROM labels),
known AS (SELECT x.doc_id AS a, y.doc_id AS b, x.quality = y.quality AS good FROM l x JOIN l y ON y.doc_id = x.doc_id + 100),
m AS (SELECT good, EXISTS (SELECT 1 FROM found f WHERE f.a = k.a AND f.b = k.b) AS hit FROM known k),
c AS (SELECT count(*) FILTER (hit AND good) AS tp, count(*) FILTER (hit AND NOT good) AS fp, count(*) FILTER (NOT hit AND good) AS fn, count(*) AS known, count(*) FILTER (good) AS positives FROM m)
SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1, positives::DOUBLE / known AS share_positive FROM c""")
def signature_stats(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    other = labels.select((F.col("doc_id") - 100).alias("doc_id"), F.col("doc_id").alias("contentid2"), F.col("quality").alias("q2"))
    known = labels.join(other, "doc_id").select(F.col("doc_id").alias("contentid1"), "contentid2", (F.col("quality") == F.col("q2")).cast("int").alias("aresimilar"))
    pairs = similarity.similar_pairs(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.8, 3))
    return feedback.confusion(feedback.canonical(pairs, "id1", "id2"), known)


# ---- scalar functions


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_extendedprice * l_quantity)::BIGINT AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, format('{:,}', n) || CASE WHEN n >= 1099511627776 THEN printf(' (%.1f TiB)', n / 1099511627776.0::DOUBLE) WHEN n >= 1073741824 THEN printf(' (%.1f GiB)', n / 1073741824.0::DOUBLE)
  WHEN n >= 1048576 THEN printf(' (%.1f MiB)', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf(' (%.1f KiB)', n / 1024.0::DOUBLE) ELSE '' END AS shown FROM x""")
def format_bytes(spark, sf_dir):
    n = F.floor(F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formatting.format_bytes(n).alias("shown"))


@query("""WITH x AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
  WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS shown FROM x""")
def format_time_delta(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", formatting.format_time_delta(F.col("o_totalprice")).alias("shown"))


@query("""SELECT page_id, octet_length(encode(html))::BIGINT AS size, (length(url) * 100)::BIGINT AS pixels, octet_length(encode(html))::DOUBLE / (length(url) * 100) AS bytes_per_pixel, sign(length(html) - 100 * length(url))::INT AS better FROM pages""")
def comparison_columns(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"), F.char_length("url").alias("w"), F.lit(100).alias("h"), F.char_length("html").alias("n"))
    return pages.select("page_id", *[c.alias(k) for k, c in formatting.comparison_columns(F.col("size"), F.col("w"), F.col("h")).items()], formatting.better_of(F.col("n"), F.col("w") * 100).alias("better"))


# ---- lines, stored texts and single rows


@query(f"""WITH f AS (
  SELECT doc_id * 2 AS file_id, '/' || source || '/' || lang AS dir, doc_id::VARCHAR AS name, text FROM documents
  UNION ALL SELECT doc_id * 2 + 1, '/' || source || '/' || lang, doc_id || '.part', substr(text, 1, length(text) // 2) FROM documents
), h AS (SELECT dir || '/' || name AS path, text, octet_length(encode(text)) AS size, {FIRST_KIB} AS k FROM f WHERE octet_length(encode(text)) >= 1024)
SELECT l.size || ';' || l.path || ';' || s.size || ';' || s.path AS line FROM h l JOIN h s ON l.k = s.k AND l.size > s.size AND starts_with(l.text, s.text)""")
def truncated_pairs_csv(spark, sf_dir):
    return render.truncated_csv(truncated_pairs(spark, sf_dir))


@query(f"""{HAMMING_SCORES}, {PATHS} SELECT printf('%.6f', 1 - distance / 64.0::DOUBLE) || ';' || a.path || ';' || b.path AS line
FROM top JOIN close ON close.id = top.id AND distance <= 6 JOIN paths a ON a.contentid = top.id JOIN paths b ON b.contentid = other""")
def similar_pairs_csv(spark, sf_dir):
    return render.similar_csv(similar_pairs_paths(spark, sf_dir))


@query(f"""{HAMMING_SCORES}, {PATHS}, o AS (SELECT top.id, any_value(score) AS score, any_value(a.path) AS center, string_agg('{{"similarity":' || (1 - distance / 64.0::DOUBLE)::VARCHAR || ',"paths":["' || b.path || '"]}}', ',' ORDER BY other) AS others
FROM top JOIN close ON close.id = top.id AND distance <= 6 JOIN paths a ON a.contentid = top.id JOIN paths b ON b.contentid = other GROUP BY 1)
SELECT '{{"score":' || score || ',"center":{{"paths":["' || center || '"]}},"others":[' || others || ']}}' AS item FROM o""")
def similar_buckets_json(spark, sf_dir):
    found = similarity.compare(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.8, 3), similarity.HAMMING_FACTORS, listed=formatting.max_distance(0.9, 3))
    return render.similar_bucket_json(similarity.with_paths(found, _paths(spark, sf_dir), 64.0, 0.9, all_paths=True))


@query(f"""{HAMMING_SCORES.replace("AS counts FROM counts", "AS marks FROM counts")}, listed AS (SELECT top.id, string_agg(other || ':' || distance, ' ' ORDER BY other) AS pairs FROM top JOIN close ON close.id = top.id AND distance <= 12 GROUP BY 1),
grid AS (SELECT top.id, d, n FROM top CROSS JOIN range(16) r(d) LEFT JOIN counts ON counts.id = top.id AND counts.distance = d),
shown AS (SELECT id, string_agg(coalesce(n::VARCHAR, ''), ',' ORDER BY d) AS row FROM grid GROUP BY 1)
SELECT top.id, top.id || ': ' || score || ' ' || total || '=' || row || ' ' || pairs AS line FROM top JOIN listed USING (id) JOIN shown USING (id)""")
def hamming_kernel_lines(spark, sf_dir):
    found = similarity.compare(_signed(spark, sf_dir), "hamming", formatting.max_distance(0.8, 3), similarity.HAMMING_FACTORS)
    return render.kernel_lines(found, 16)


@query("""WITH d AS (SELECT doc_id, substr(sha1(text), 1, 16) AS digits FROM documents WHERE text IS NOT NULL), n AS (SELECT *, ('0x' || digits)::UBIGINT::HUGEINT AS u FROM d)
SELECT doc_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS number, digits FROM n""")
def hex_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", hashing.hex_to_long(F.substring(F.sha1(F.col("text").cast("binary")), 1, 16)).alias("number"))
    return rows.withColumn("digits", hashing.long_to_hex(F.col("number")))


TONES = "tones AS (SELECT vec_id, list_transform(range(64), lambda i: (floor(abs(embedding[i % len(embedding) + 1]::DOUBLE) * 4000))::BIGINT % 256) AS v FROM embeddings)"


def _sql_hash(bits: str, tones: str = "tones") -> str:
    """The hex digits of 64 bits of 8 x 8 tones."""
    return f"""b AS (SELECT vec_id, {bits} AS b FROM {tones})
SELECT vec_id, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', (('0b' || substr(b, i * 4 + 1, 4))::INT + 1)::INT, 1)), '') AS hash FROM b"""


def _image_signatures(spark, sf_dir, iht: int) -> DataFrame:
    """Signatures of the same tones as gray images of 8 x 8."""
    v = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.floor(F.abs(F.get("embedding", i % F.size("embedding")).cast("double")) * 4000) % 256)
    data = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("contentid"), F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data")).alias("image"))
    return signatures.image_signatures(images, [iht]).select(F.col("contentid").alias("vec_id"), "hash")


@query(f"""WITH {TONES}, {_sql_hash("array_to_string(list_transform(v, lambda x: CASE WHEN x * 64 >= list_sum(v) THEN '1' ELSE '0' END), '')")}""")
def average_signatures(spark, sf_dir):
    return _image_signatures(spark, sf_dir, 4)


@query(f"""WITH {TONES}, paths AS (SELECT vec_id, v, list_transform(range(64), lambda i: v[CASE WHEN (i // 8) % 2 = 0 THEN i + 1 ELSE (i // 8) * 8 + 8 - i % 8 END]) AS p FROM tones
), {_sql_hash("array_to_string(list_transform(range(64), lambda i: CASE WHEN p[i + 1] >= (CASE WHEN i = 0 THEN v[57] ELSE p[i] END) THEN '1' ELSE '0' END), '')", "paths")}""")
def difference_signatures(spark, sf_dir):
    return _image_signatures(spark, sf_dir, 3)


@query(f"""WITH {TONES}, c AS (SELECT vec_id, list_transform(range(16), lambda k: len(list_filter(v, lambda x: x // 16 = k))) AS c FROM tones)
SELECT vec_id, array_to_string(list_transform(c, lambda n: lower(printf('%x', (65535 * n) // 64))), ' ') AS hash FROM c""")
def histogram_signatures(spark, sf_dir):
    return _image_signatures(spark, sf_dir, 1)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'moved' ELSE c_mktsegment END AS segment FROM customer WHERE c_nationkey <> 3""")
def store_update_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return store.delete(store.update_one(rows, 7, segment="moved"), nation=3).select("id", "segment")


@query("""SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2) UNION ALL SELECT c_custkey FROM customer WHERE c_custkey = 11""")
def repo_find_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    one = spark.createDataFrame([(store.load(rows, 11).id,)], "id long")
    return store.find_ids(rows, segment="BUILDING", nation=store.In([1, 2])).unionByName(one)


@query("""WITH f AS (SELECT doc_id AS file_id, hex(encode(text)) AS x, octet_length(encode(text)) AS size FROM documents WHERE octet_length(encode(text)) >= 2049)
SELECT file_id, len(list_filter(range(11, 31), lambda k: (1 << k) < size))::INT AS n, sha1(unhex(substr(x, 1, 4096))) AS first_part FROM f""")
def stored_parts(spark, sf_dir):
    from .schema import parts_from_text, parts_to_text

    rows = document_files(spark, sf_dir, 2049).select("file_id", parts_from_text(parts_to_text(hashing.prefix_sha1s(F.col("content")))).alias("parts"))
    return rows.select("file_id", F.size("parts").alias("n"), F.element_at("parts", F.lit(2048).cast("long")).alias("first_part"))


@query("""SELECT page_id, chr(39) || replace(url || chr(39), chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) AS quoted FROM pages""")
def shell_quoted(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", formatting.shell_quote(F.concat("url", F.lit("'"))).alias("quoted"))
