"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that name it in WARC-Refers-To and carry its
target URI, date and payload digest. Expressions are built in, so the work
stays in the JVM and DuckDB can say the same.

A response's block may begin with an HTTP header (``HTTP/1.x`` line up to the
first empty line); its status, content type and then all its fields
(``http-header-`` and the name, in their order) go into the metadata, and
only what follows is the payload. The source's own record id, date, payload
digest and block digest are kept where columns name them; where they are null
or there are none, id, date and payload digest are made up. Record ids are made
from the kind, the page, the URI and the payload digest, and from the source's
id where it is given, so a rerun gives the same ids.

Defined cases: null URLs and null bodies count as empty; a page without either
still gives both records, of empty blocks' lengths. Repeated rows repeat their
records. No column is read but those named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

DATE = "2024-01-01T00:00:00Z"  # where the source has none
S = r"[ \t\r\n\f]"
_SHUT = rf"</(script|style|noscript|template){S}*>"
HIDDEN = rf"(?is)<(script|style|noscript|template)\b[^<>]*>.*?{_SHUT}"
COMMENT = r"(?s)<!--.*?-->"
BREAK = r"(?i)<(br|p|/p|div|/div|li|/li|tr|/tr|h[1-6]|/h[1-6])\b[^<>]*>"
TAG = r"<[^<>]*>"
TITLE = rf"(?is)<title\b[^<>]*>(.*?)</title{S}*>"
LINK = r"""(?i)<a\b[^<>]*\bhref=["']?([^"' <>]+)"""
FIELD = r"(?m)^([^\r\n:]+):[ \t]*([^\r\n]*(?:\r?\n[ \t]+[^\r\n]*)*)"
#: The same in loops that never give back, so that long heads do not fill the stack.
_FIELD = r"(?m)^([^\r\n:]++):[ \t]*+([^\r\n]*+(?:\r?\n[ \t]++[^\r\n]*+)*+)"
HEAD = r"(?s)^HTTP/1\.[01] .*?\r?\n\r?\n"
#: Entities that are resolved, in this order; the ampersand comes last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


_OPEN, _CLOSE = r"<(?:script|style|noscript|template)\b[^<>]*>", rf"</(?:script|style|noscript|template){S}*+>"
#: HIDDEN in loops that never give back; an element that is never closed is taken to the end of the text as group 1, so that no later one is looked at again.
_HIDDEN = rf"(?is){_OPEN}[^<]*+(?:(?!{_CLOSE})<[^<]*+)*+{_CLOSE}|({_OPEN}.*)"
#: COMMENT and TITLE in the same way; group 1 of TITLE is empty where nothing closes the element.
_COMMENT = r"(?s)<!--[^-]*+(?:-(?!->)[^-]*+)*+-->|(<!--.*)"
_TITLE = rf"(?is)<title\b[^<>]*>(?:(.*?)</title{S}*>|.*)"
#: Runs of tags and blanks, &nbsp; too.
_BLANKS = r"(?:[ \t\r\f]|<[^<>]*+>|&nbsp;)++"


def _resolved(name: str, char: str):
    """``name`` replaced by ``char`` where it is there: looking is much faster than replacing."""
    return lambda text: F.when(F.contains(text, F.lit(name)), F.replace(text, F.lit(name), F.lit(char))).otherwise(text)


def plain_text(html: Column) -> Column:
    """Visible text: hidden elements, comments and tags go, block tags end a line, blanks collapse. A tag ends at the next < or >."""
    out = F.regexp_replace(html, _HIDDEN, "$1 ")  # a blank after what is never closed is at the end of the text
    out = F.regexp_replace(out, _COMMENT, "$1 ")
    out = F.regexp_replace(out, BREAK, "\n")
    out = F.regexp_replace(out, _BLANKS, " ")
    for name, char in ENTITIES[1:]:  # the first one is a blank
        out = T.let(out, _resolved(name, char))
    return F.btrim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def derivatives(responses: DataFrame, key: str = "page_id", uri: str = "url", block: str = "html", date: str = DATE, source_id: str | None = None, source_date: str | None = None, source_payload_digest: str | None = None, source_block_digest: str | None = None) -> DataFrame:
    """Two rows for each response: key, warc_type, record_id, refers_to, header (text), block (text) and their digests.

    The last four name columns of the source's WARC-Record-ID, WARC-Date,
    WARC-Payload-Digest and WARC-Block-Digest, as text; the block digest goes
    into the metadata.
    """
    given = {"given_id": source_id, "given_date": source_date, "given_payload": source_payload_digest, "source_block_digest": source_block_digest}
    kept = [(F.col(c) if c else F.lit(None)).cast("string").alias(n) for n, c in given.items()]
    base = responses.select(F.col(key).alias("key"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), F.coalesce(F.col(block), F.lit("")).alias("raw"), *kept)
    base = base.select("key", "uri", "raw", *given, F.regexp_extract("raw", HEAD, 0).alias("http"))
    base = base.select("key", "uri", "http", *given, F.expr("substr(raw, length(http) + 1)").alias("body"))
    base = base.select("*", F.coalesce("given_payload", F.concat(F.lit("sha256:"), F.sha2("body", 256))).alias("payload_digest"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("k"), F.coalesce("given_date", F.lit(date)).alias("date"))
    base = base.select("*", F.coalesce("given_id", _uuid(F.lit("response"), F.col("k"), F.col("uri"), F.col("payload_digest"))).alias("source_id"), plain_text(F.col("body")).alias("text"))
    title = F.regexp_replace(F.regexp_extract("body", _TITLE, 1), r"[ \t\r\n\f]+", " ")
    links = F.regexp_extract_all("body", F.lit(LINK), F.lit(1))
    status = F.regexp_extract("http", r"^HTTP/1\.[01] ([0-9]+)", 1)
    kind = F.regexp_extract("http", r"(?i)\ncontent-type: *([^\r\n]*)", 1)
    names, values = (F.regexp_extract_all(F.regexp_replace("http", r"^[^\r\n]*", ""), F.lit(_FIELD), F.lit(i)) for i in (1, 2))
    fields = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.concat(F.lit("\r\nhttp-header-"), F.trim(x["n"]), F.lit(": "), F.regexp_replace(x["v"], r"\r?\n[ \t]+", " ")))
    base = base.select("*", title.alias("title"), links.alias("links"), F.coalesce(F.nullif(status, F.lit("")), F.lit("200")).alias("status"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("text/html")).alias("kind"))
    meta = F.concat(
        F.lit("status: "), "status", F.lit("\r\ncontent-type: "), "kind", F.lit("\r\ntitle: "), "title", F.lit("\r\ntext-digest: sha256:"), F.sha2("text", 256),
        F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit("\r\noutlink: "), x))),
        F.concat_ws("", fields), F.coalesce(F.concat(F.lit("\r\nsource-block-digest: "), "source_block_digest"), F.lit("")), F.lit("\r\n"),
    )
    one = lambda t, ct, b: F.struct(F.lit(t).alias("warc_type"), F.lit(ct).alias("content_type"), b.alias("block"))
    rows = base.select("key", "uri", "payload_digest", "source_id", "given_id", "date", "k", F.size("links").cast("int").alias("n_links"), F.explode(F.array(one("metadata", "application/warc-fields", meta), one("conversion", "text/plain", F.col("text")))).alias("r"))
    rows = rows.select("key", "uri", "payload_digest", "source_id", "given_id", "date", "k", "n_links", "r.*")
    rows = rows.withColumn("record_id", _uuid(F.col("warc_type"), F.col("k"), F.col("uri"), F.col("payload_digest"), F.col("given_id"))).withColumn("block_digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))).withColumn("content_length", F.octet_length("block").cast("bigint"))
    line = lambda n, v: F.concat(F.lit(n + ": "), v, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("uri")), line("WARC-Refers-To", F.col("source_id")),
        line("WARC-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return rows.select(F.col("key").alias(key), "warc_type", "record_id", F.col("source_id").alias("refers_to"), F.col("uri").alias("target_uri"), "content_type", "content_length", "block_digest", "payload_digest", "n_links", header.alias("header"), "block")


def record_bytes(header: Column, block: Column) -> Column:
    """A whole record as it stands in a WARC file."""
    return F.concat(header.cast("binary"), block.cast("binary"), F.lit(b"\r\n\r\n"))


#: What ends a record, and the columns that ``read_records`` makes of header fields.
END = "\r\n\r\n"
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "date": "WARC-Date", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type"}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzip: FIELDS, content_length, block (its bytes as text) and whole.

    Files are cut at the end of a record that a new one follows, by the reader
    itself, so plain files are split among tasks. A block that holds this mark
    is cut there: its record is not ``whole`` and what follows has no warc_type.
    Header fields that are missing are null; an empty file gives no row.
    """
    rows = spark.read.option("lineSep", END + "WARC/1.").text(path)
    rows = rows.select("value", F.regexp_extract("value", r"(?s)^(?:WARC/1\.)?[0-9]\r\n.*?\r\n\r\n", 0).alias("head"))
    field = lambda n: F.nullif(F.trim(F.regexp_extract("head", rf"(?i)\n{n}:([^\r\n]*)", 1)), F.lit(""))
    size = field("Content-Length").try_cast("int").alias("size")
    rows = rows.select(*[field(n).alias(c) for c, n in FIELDS.items()], size, F.expr("cast(substr(value, length(head) + 1) as binary)").alias("rest"))
    block = F.coalesce(F.substring("rest", F.lit(1), F.col("size")), F.col("rest")).cast("string")
    return rows.select(*FIELDS, F.col("size").cast("bigint").alias("content_length"), block.alias("block"), F.coalesce(F.octet_length("rest") >= F.col("size"), F.lit(False)).alias("whole"))


def of_records(records: DataFrame) -> DataFrame:
    """Derivatives of the responses among ``records`` (as ``read_records`` gives them), which keep their ids, dates and digests. The key is the record id."""
    responses = records.where((F.col("warc_type") == "response") & F.col("whole")).select(F.col("record_id").alias("key"), "record_id", "target_uri", "block", "date", "payload_digest", "block_digest")
    return derivatives(responses, "key", "target_uri", "block", source_id="record_id", source_date="date", source_payload_digest="payload_digest", source_block_digest="block_digest")


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Rows with ``header`` and ``block`` as WARC files, one for each partition (``none`` leaves them plain, so that readers can split them)."""
    records.select(F.concat("header", "block")).write.option("lineSep", END).option("compression", compression).text(path)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Digests of both records of every page."""
    return derivatives(pages).select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", "n_links", F.sha2(record_bytes(F.col("header"), F.col("block")), 256).alias("record_sha256"))


def sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = "body"
    for pattern, to in ((HIDDEN, "' '"), (COMMENT, "' '"), (BREAK, "chr(10)"), (TAG, "' '")):
        text = f"regexp_replace({text}, {q(pattern)}, {to}, 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(char)})"
    text = f"regexp_replace({text}, {q('[ \\t\\r\\f]+')}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {q(' ?\\n[ \\n]*')}, chr(10), 'g'), {q('^[ \\n]+|[ \\n]+$')}, '', 'g')"
    uuid = lambda parts: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5(concat_ws('|', {parts})) AS h))"
    crlf = "chr(13) || chr(10)"
    header = " || ".join(f"'{n}: ' || {v} || {crlf}" for n, v in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", q(DATE)), ("WARC-Target-URI", "uri"), ("WARC-Refers-To", "source_id"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "CAST(content_length AS VARCHAR)")))
    rest = f"regexp_replace(http, {q('^[^\\r\\n]*')}, '')"
    fields = f"list_transform(list_zip(regexp_extract_all({rest}, {q(FIELD)}, 1), regexp_extract_all({rest}, {q(FIELD)}, 2)), lambda x: {crlf} || 'http-header-' || trim(x[1]) || ': ' || regexp_replace(x[2], {q('\\r?\\n[ \\t]+')}, ' ', 'g'))"
    return f"""
      WITH raw AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS raw FROM pages),
      split AS (SELECT *, regexp_extract(raw, {q(HEAD)}) AS http FROM raw),
      body AS (SELECT page_id, uri, http, substr(raw, length(http) + 1) AS body, coalesce(CAST(page_id AS VARCHAR), '') AS k FROM split),
      dig AS (SELECT *, 'sha256:' || sha256(body) AS payload_digest, {text} AS text FROM body),
      src AS (SELECT *, {uuid("'response', k, uri, payload_digest")} AS source_id,
        regexp_replace(regexp_extract(body, {q(TITLE)}, 1), {q('[ \\t\\r\\n\\f]+')}, ' ', 'g') AS title, regexp_extract_all(body, {q(LINK)}, 1) AS links,
        coalesce(nullif(regexp_extract(http, {q('^HTTP/1[.][01] ([0-9]+)')}, 1), ''), '200') AS status,
        coalesce(nullif(regexp_extract(http, {q('(?i)\\ncontent-type: *([^\\r\\n]*)')}, 1), ''), 'text/html') AS kind FROM dig),
      recs AS (
        SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, 'status: ' || status || {crlf} || 'content-type: ' || kind || {crlf} || 'title: ' || title || {crlf} || 'text-digest: sha256:' || sha256(text)
          || coalesce(array_to_string(list_transform(links, lambda x: {crlf} || 'outlink: ' || x), ''), '') || coalesce(array_to_string({fields}, ''), '') || {crlf} AS block FROM src
        UNION ALL SELECT *, 'conversion', 'text/plain', text FROM src),
      ided AS (SELECT *, {uuid("warc_type, k, uri, payload_digest")} AS record_id, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM recs)
      SELECT page_id, warc_type, record_id, source_id AS refers_to, uri AS target_uri, content_type, content_length, block_digest, payload_digest, CAST(len(links) AS INTEGER) AS n_links,
        sha256('WARC/1.1' || {crlf} || {header} || {crlf} || block || {crlf} || {crlf}) AS record_sha256 FROM ided"""
