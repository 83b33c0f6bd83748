"""WARC derivative builder (operator 9).

Each response record gives two records that refer to it: a metadata record (application/warc-fields: title,
outlinks, the source's HTTP headers and digests) and a conversion record (text/plain: the page's text). Both keep
the source's target URI and date, carry its record id in WARC-Refers-To, its payload digest, and a block digest of
their own. Everything is column expressions; a row is worked on alone, without a shuffle.

Text: scripts, styles and comments go, block tags break lines, other tags vanish, entities are resolved (common
names, decimal and hexadecimal numbers), blanks and breaks are run together.

Defined results: null html reads as an empty payload, whose text is empty; a null url stays a null target URI;
record ids follow from type, id, url and payload, so rows that repeat have equal ids; pages without a title or
links have no such lines; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

DATE = "2024-01-01T00:00:00Z"
# RFC 4648 base 32 alphabet; named entities and their characters.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ENTITIES = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("copy", "©"), ("reg", "®"), ("middot", "·"), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("laquo", "«"), ("raquo", "»"), ("euro", "€"), ("amp", "&")]
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|div|dd|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|title|tr|ul)\b[^>]*>"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?([^"'>\s]+)"""


def digest(content: Column) -> Column:
    """``sha1:`` and the hash in base 32."""
    hexed = F.sha1(content)
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))  # 20 bits each
    letter = lambda n, bit: F.substr(F.lit(BASE32), F.shiftright(n, bit).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(F.lit("sha1:"), F.array_join(F.transform(groups, lambda n: F.concat(*[letter(n, bit) for bit in (15, 10, 5, 0)])), ""))


def record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def unescaped(text: Column) -> Column:
    """Text with its entities resolved once, from left to right; what is no known entity stays."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair])

    def piece(x: Column, i: Column) -> Column:
        name = F.substring_index(x, ";", 1)
        rest = F.substr(x, F.length(name) + 2)
        number = F.when(name.rlike(r"^#\d{1,7}$"), F.substr(name, F.lit(2)).cast("long")).when(name.rlike(r"^#[xX][0-9A-Fa-f]{1,6}$"), F.conv(F.substr(name, F.lit(3)), 16, 10).cast("long"))
        fine = number.between(32, 55295) | number.between(57344, 1114111)
        char = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        known = F.when(F.length(name) < F.length(x), F.coalesce(F.try_element_at(names, name), char))
        return F.when(i == 0, x).otherwise(F.coalesce(F.concat(known, rest), F.concat(F.lit("&"), x)))

    return F.array_join(F.transform(F.split(text, "&"), piece), "")


def _tidy(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses_of(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, headers_col: str | None = None) -> DataFrame:
    """Response records of fetched pages: source_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest.

    headers_col: the status line and headers as they came, lines ending in CR LF; without it those of a plain page.
    """
    plain = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce(html_col, F.lit(""))).cast("string"))
    headers = plain if headers_col is None else F.coalesce(F.rtrim(F.col(headers_col), F.lit("\r\n")), plain)
    rows = pages.select(F.col(id_col).alias("source_id"), F.col(url_col).alias("target_uri"), F.coalesce(html_col, F.lit("")).alias("payload"), headers.alias("http_headers"))
    rows = rows.withColumn("payload_digest", digest(F.col("payload").cast("binary")))
    return rows.select("source_id", record_id(F.lit("response"), F.col("source_id"), F.col("target_uri"), F.col("payload_digest")).alias("record_id"), "target_uri", F.lit(date).alias("warc_date"), "http_headers", "payload", "payload_digest")


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each response: source_id, warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_digest, block."""
    bare = responses.withColumn("_bare", F.regexp_replace("payload", HIDDEN, " "))
    read = bare.select(
        "source_id", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest",
        F.regexp_replace(F.regexp_replace("_bare", BLOCKS, "\n"), r"<[^>]*>", "").alias("_text"),
        F.regexp_extract("_bare", TITLE, 1).alias("_title"), F.regexp_extract_all("_bare", F.lit(HREF), F.lit(1)).alias("_links"),
    )
    read = read.withColumns({"_text": unescaped(F.col("_text")), "_title": unescaped(F.col("_title"))})
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    title = F.replace(_tidy(F.col("_title")), F.lit("\n"), F.lit(" "))
    links = F.array_join(F.transform("_links", lambda x: line("outlink", x)), "")
    headers = F.array_join(F.transform(F.split("http_headers", "\r\n"), lambda x: line("source-header", x)), "")
    built = read.select(
        "source_id", "record_id", "target_uri", "warc_date", "payload_digest", _tidy(F.col("_text")).alias("_text"),
        F.concat(F.when(title != "", line("title", title)).otherwise(""), links, headers, line("source-payload-digest", F.col("payload_digest"))).alias("_fields"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.col("_fields").alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("_text").alias("block")),
    )
    rows = built.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("payload_digest").alias("source_digest"), F.explode(kinds).alias("k")).select("*", "k.*").drop("k")
    return rows.select(
        "source_id", "warc_type", record_id(F.col("warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "warc_date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block").cast("binary")).alias("block_digest"), "source_digest", "block",
    )


def warc_bytes(records: DataFrame) -> DataFrame:
    """records with a column warc: the whole record as WARC/1.1 bytes."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.withColumn("warc", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).cast("binary"))


def op9_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses_of(read_table(spark, sf_dir, "pages"))).withColumnRenamed("source_id", "page_id")


def _sql_digest(text: str) -> str:
    return f"'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', ((('0x' || substr(sha1({text}), (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '')"


def _sql_id(*parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce({p}::VARCHAR, '')" for p in parts)
    return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({joined}) AS h))"


def _sql_unescaped(text: str) -> str:
    name = "split_part(x, ';', 1)"
    number = f"CASE WHEN regexp_matches({name}, '^#\\d{{1,7}}$') THEN substr({name}, 2)::BIGINT ELSE ('0x' || substr({name}, 3))::BIGINT END"
    named = " ".join("WHEN {} = '{}' THEN '{}'".format(name, k, v.replace("'", "''")) for k, v in ENTITIES)
    fine = f"regexp_matches({name}, '^#(\\d{{1,7}}|[xX][0-9A-Fa-f]{{1,6}})$') THEN CASE WHEN {number} BETWEEN 32 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr(({number})::INT) END"
    known = f"CASE WHEN length({name}) = length(x) THEN NULL {named} WHEN {fine} END"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda x, i: CASE WHEN i = 1 THEN x ELSE coalesce({known} || substr(x, length({name}) + 2), '&' || x) END), '')"


def _sql_tidy(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '[\\t\\r\\f][ \\t\\r\\f]*| [ \\t\\r\\f]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


_QUOTE = lambda x: x.replace("'", "''")
OP9_SQL = f"""
WITH r AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, {_sql_digest("coalesce(html, '')")} AS source_digest FROM pages
), b AS (
  SELECT *, {_sql_id("'response'", "page_id", "target_uri", "source_digest")} AS refers_to, regexp_replace(payload, '{HIDDEN}', ' ', 'g') AS bare FROM r
), t AS (
  SELECT *, {_sql_unescaped(f"regexp_replace(regexp_replace(bare, '{BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g')")} AS raw,
    {_sql_unescaped(f"regexp_extract(bare, '{TITLE}', 1)")} AS raw_title, regexp_extract_all(bare, '{_QUOTE(HREF)}', 1) AS links FROM b
), f AS (
  SELECT *, replace({_sql_tidy("raw_title")}, chr(10), ' ') AS title, {_sql_tidy("raw")} AS body, chr(13) || chr(10) AS nl FROM t
), k AS (
  SELECT page_id, 'conversion' AS warc_type, refers_to, target_uri, 'text/plain' AS content_type, source_digest, body AS block FROM f
  UNION ALL
  SELECT page_id, 'metadata', refers_to, target_uri, 'application/warc-fields', source_digest,
    CASE WHEN title <> '' THEN 'title: ' || title || nl ELSE '' END || array_to_string(list_transform(links, lambda x: 'outlink: ' || x || nl), '')
    || 'source-header: HTTP/1.1 200 OK' || nl || 'source-header: Content-Type: text/html; charset=utf-8' || nl || 'source-header: Content-Length: ' || octet_length(encode(payload)) || nl
    || 'source-payload-digest: ' || source_digest || nl FROM f
)
SELECT page_id, warc_type, {_sql_id("warc_type", "refers_to")} AS record_id, refers_to, target_uri, '{DATE}' AS warc_date, content_type, octet_length(encode(block))::BIGINT AS content_length,
  {_sql_digest("block")} AS block_digest, source_digest, block FROM k
"""
