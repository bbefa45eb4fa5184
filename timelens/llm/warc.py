"""WARC derivatives: linked metadata and plain-text conversion records made from responses.

Every captured page is a response. Two records are derived from it: a ``metadata`` record (title, language, links,
source headers) and a ``conversion`` record (the plain text). Both carry ``WARC-Refers-To`` with the response's record
id, its target URI and date, and the response's own headers and digests; each has block and payload digests of its own,
so that a reader can check them. All of it is Spark SQL: one narrow pass over the pages, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query, table

CRLF = "\r\n"
# The record types' content types.
TYPES = {"metadata": "application/warc-fields", "conversion": "text/plain; charset=utf-8"}
# Elements without reading text, and elements that end a line.
HIDDEN = ["script", "style", "noscript", "template"]
BLOCKS = "p|br|div|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|article|section|header|footer|nav|title"
# Named character references but for the ampersand, which comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·")]
AMPERSAND = r"&(?:amp|#0{0,5}38|#[xX]0{0,4}26);"
NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
GONE = "(?is)<(?:!--.*?-->|" + "|".join(rf"{n}[^>]*>.*?</{n}[ ]*>" for n in HIDDEN) + ")"
BREAKS = rf"(?i)</?(?:{BLOCKS})(?:[ /][^>]*)?>"
LINK = r"""(?i)<a[ \t\r\n\f](?:[^>]*?[ \t\r\n\f])?href[ \t\r\n\f]*=[ \t\r\n\f]*("[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+)"""


def urn(*parts: Column) -> Column:
    """A record id made from the record's contents: the same input gives the same id in any run."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def character(ref: Column) -> Column:
    """What a numeric reference stands for; itself if that is no character. Ampersands wait for the last step."""
    number = F.regexp_extract(ref, "([0-9a-fA-F]+);", 1)
    code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(number, 16, 10)).otherwise(number).cast("long")
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)


def plain_text(html: Column) -> Column:
    """Reading text: comments, hidden elements and tags go, blocks end lines, references become characters."""
    t = F.regexp_replace(html, GONE, " ")
    t = F.regexp_replace(t, BREAKS, "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    named = t
    for ref, char in ENTITIES:
        named = F.replace(named, F.lit(ref), F.lit(char))
    numbered = F.aggregate(F.array_distinct(F.regexp_extract_all(named, F.lit(NUMERIC), F.lit(0))), named, lambda acc, ref: F.replace(acc, ref, character(ref)))
    t = F.when(F.contains(t, F.lit("&")), F.regexp_replace(F.when(F.contains(t, F.lit("&#")), numbered).otherwise(named), AMPERSAND, "&")).otherwise(t)
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def headers(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a header without a value is left out."""
    return F.concat_ws(CRLF, *[F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in pairs])


def octets(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def derive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z",
           http_headers: str = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8", record_id_col: str | None = None, date_col: str | None = None,
           headers_col: str | None = None, digest_col: str | None = None) -> DataFrame:
    """Two rows for every page, ``metadata`` and ``conversion``.

    Columns: ``page_id``, ``record_type``, ``record_id``, ``refers_to`` (the response's id), ``target_uri``, ``warc_header``
    (all header lines), ``content`` (the block), ``content_length``, ``block_digest``, ``payload_digest``,
    ``source_payload_digest``, ``source_header``.

    A table of captured responses names its own columns for the response's record id, date, HTTP headers and payload digest; they
    are carried over as they are. Where such a column is not named, or null, the id is made from page, url and payload digest (two
    captures of one page have two ids), ``date`` and ``http_headers`` hold, and the digest is the SHA-256 of the html.

    A null html is an empty response and gives an empty text; a null url gives records without a target URI. Repeated
    rows give the same records again, with the same ids. Ids of records do not depend on partitions or runs. An
    unclosed comment or script stays as text. Links are ``href`` of ``a`` in double, single or no quotes. Numeric references
    that stand for no character stay. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    def given(name: str | None, otherwise: Column) -> Column:
        return otherwise if name is None else F.coalesce(F.col(name).cast("string"), otherwise)

    page, url, html = F.col(id_col), F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    payload = F.concat(F.lit("sha256:"), F.sha2(html, 256))
    made = urn(F.lit("response"), F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), payload)
    base = pages.select(page.alias("page_id"), url.alias("target_uri"), html.alias("h"), given(headers_col, F.lit(http_headers)).alias("source_header"),
                        given(digest_col, payload).alias("source_payload_digest"), given(record_id_col, made).alias("refers_to"), given(date_col, F.lit(date)).alias("date"))
    unquoted = lambda x: F.when(x.startswith('"') | x.startswith("'"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    base = (base.withColumn("text", plain_text(F.col("h")))
            .withColumn("title", F.nullif(F.trim(F.regexp_extract("h", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))
            .withColumn("html_lang", F.nullif(F.regexp_extract("h", r"(?i)<html[^>]* lang=\"([^\"]*)\"", 1), F.lit("")))
            .withColumn("links", F.transform(F.regexp_extract_all("h", F.lit(LINK), F.lit(1)), unquoted)))
    fields = F.concat(headers(("title", F.col("title")), ("language", F.col("html_lang")), ("outlinks", F.size("links").cast("string")),
                              ("source-http-header-lines", F.size(F.split("source_header", CRLF)).cast("string"))),
                      F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit(f"{CRLF}outlink: "), x))), F.lit(CRLF))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), fields.alias("content")),
                    F.struct(F.lit("conversion").alias("record_type"), F.col("text").alias("content")))
    rows = base.select("page_id", "target_uri", "refers_to", "date", "source_header", "source_payload_digest", F.inline(kinds))
    digest = F.concat(F.lit("sha256:"), F.sha2(F.col("content"), 256))
    rows = (rows.withColumn("content_length", octets(F.col("content"))).withColumn("block_digest", digest).withColumn("payload_digest", digest)
            .withColumn("record_id", urn(F.col("record_type"), F.col("refers_to"))))
    kind = F.when(F.col("record_type") == "metadata", TYPES["metadata"]).otherwise(TYPES["conversion"])
    lines = headers(("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
                    ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")),
                    ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")), ("WARC-Payload-Digest", F.col("payload_digest")),
                    ("WARC-Source-Payload-Digest", F.col("source_payload_digest")), ("Content-Type", kind),
                    ("Content-Length", F.col("content_length").cast("string")))
    return rows.withColumn("warc_header", F.concat(F.lit(f"WARC/1.1{CRLF}"), lines)).select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_header", "content", "content_length", "block_digest",
        "payload_digest", "source_payload_digest", "source_header")


def _sql_text() -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace(h, '{GONE}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for ref, char in ENTITIES:
        t = "replace({}, '{}', '{}')".format(t, ref, char.replace("'", "''"))
    code = "CASE WHEN lower(r[3]) = 'x' THEN CAST('0x' || regexp_extract(r, '([0-9a-fA-F]+);', 1) AS BIGINT) ELSE CAST(regexp_extract(r, '([0-9]+);', 1) AS BIGINT) END"
    is_char = f"({code}) BETWEEN 1 AND 1114111 AND ({code}) NOT BETWEEN 55296 AND 57343 AND ({code}) <> 38"
    t = (f"list_reduce(list_concat([{t}], list_distinct(regexp_extract_all({t}, '{NUMERIC}'))), "
         f"lambda acc, r: replace(acc, r, CASE WHEN {is_char} THEN chr(CAST({code} AS INTEGER)) ELSE r END))")
    t = rf"regexp_replace(regexp_replace({t}, '{AMPERSAND}', '&', 'g'), '[ \t\r\f]+', ' ', 'g')"
    return rf"trim(regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


def _sql_urn(*parts: str) -> str:
    h = "md5(" + " || '|' || ".join(parts) + ")"
    return ("'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'")


_LINK = LINK.replace("'", "''")
SQL = f"""
WITH p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS h, 'sha256:' || sha256(coalesce(html, '')) AS source_payload_digest, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' AS source_header FROM pages),
b AS (SELECT *, {_sql_urn("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(target_uri, '')", "source_payload_digest")} AS refers_to, {_sql_text()} AS text,
      nullif(trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
      nullif(regexp_extract(h, '(?i)<html[^>]* lang="([^"]*)"', 1), '') AS html_lang,
      list_transform(regexp_extract_all(h, '{_LINK}', 1), lambda x: CASE WHEN x[1] IN ('"', '''') THEN x[2:-2] ELSE x END) AS links FROM p),
r AS (SELECT page_id, target_uri, refers_to, source_header, source_payload_digest, 'conversion' AS record_type, text AS content FROM b
      UNION ALL
      SELECT page_id, target_uri, refers_to, source_header, source_payload_digest, 'metadata',
      concat_ws(chr(13) || chr(10), 'title: ' || title, 'language: ' || html_lang, 'outlinks: ' || len(links), 'source-http-header-lines: 2')
      || coalesce(array_to_string(list_transform(links, lambda x: chr(13) || chr(10) || 'outlink: ' || x), ''), '') || chr(13) || chr(10) FROM b),
d AS (SELECT *, CAST(strlen(content) AS BIGINT) AS content_length, 'sha256:' || sha256(content) AS block_digest, {_sql_urn("record_type", "refers_to")} AS record_id FROM r)
SELECT page_id, record_type, record_id, refers_to, target_uri,
  'WARC/1.1' || chr(13) || chr(10) || concat_ws(chr(13) || chr(10), 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to,
  'WARC-Refers-To-Target-URI: ' || target_uri, 'WARC-Refers-To-Date: 1970-01-01T00:00:00Z', 'WARC-Target-URI: ' || target_uri, 'WARC-Date: 1970-01-01T00:00:00Z',
  'WARC-Block-Digest: ' || block_digest, 'WARC-Payload-Digest: ' || block_digest, 'WARC-Source-Payload-Digest: ' || source_payload_digest,
  'Content-Type: ' || CASE WHEN record_type = 'metadata' THEN '{TYPES["metadata"]}' ELSE '{TYPES["conversion"]}' END,
  'Content-Length: ' || content_length) AS warc_header,
  content, content_length, block_digest, block_digest AS payload_digest, source_payload_digest, source_header FROM d
"""


@query("op9_warc_derivatives", SQL)
def op9(spark, sf):
    """Metadata and conversion records of every page."""
    return derive(table(spark, sf, "pages"))
