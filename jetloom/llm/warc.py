"""Derived WARC records: a metadata and a plain-text conversion record for every response record.

Record identifiers are name-based UUIDs, so a rerun derives the same records. Derived records point back with
``WARC-Refers-To``, repeat the source's target URI and date, carry digests of their own block, and the metadata record
keeps the source's headers, payload digest and length. Everything is DataFrame functions; files are written and read by
Spark's text source with the record separator as line separator, so a file is never held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetloom.llm.staging import narrow
from jetloom.llm.text import SPACE_REGEX

VERSION = "WARC/1.1"
#: Records end with two line ends.
RECORD_END = "\r\n\r\n"
#: The next record begins right after the two line ends that close the one before it.
RECORD_BREAK = f"{RECORD_END}{VERSION}\r\n"

# What the plain text leaves out: comments, then elements without page text, then tags; the common references are decoded.
_SILENT = "(?is)<!--.*?-->" + "".join(rf"|<{tag}\b.*?</{tag}\s*>" for tag in ("script", "style", "title", "noscript", "template"))
_BREAKS = r"(?i)</?(p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|table|tr|td|th|blockquote|br|body|html|head|main|aside)\b[^>]*>"
_TAGS = r"<[^>]*>"
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))


def digest(value: Column) -> Column:
    """Labelled digest of a text's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(value, "UTF-8"), 256))


def record_id(*parts: Column) -> Column:
    """A UUID URN named by the parts (first 128 bits of their SHA-256, version 8 layout)."""
    h = F.sha2(F.encode(F.concat_ws("|", *parts), "UTF-8"), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(13, 3), F.lit("-8"), cut(16, 3), F.lit("-"), cut(19, 12), F.lit(">")
    )


def plain_text(html: Column) -> Column:
    """Text of a page: tags out, block breaks as newlines, blanks folded, common references decoded."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _SILENT, " "), SPACE_REGEX, " "), _BREAKS, "\n")
    text = F.regexp_replace(text, _TAGS, "")
    for reference, char in _REFERENCES:
        text = F.replace(text, F.lit(reference), F.lit(char))
    text = F.regexp_replace(text, " *\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of a table of pages: ``key, record_id, target_uri, date, http_headers, payload``.

    The table holds no crawl time or HTTP headers; ``date`` and minimal headers stand for them. NULL urls and pages are empty.
    """
    rows = narrow(pages, key=key, url=url, payload=html)
    uri, payload = F.coalesce("url", F.lit("")), F.coalesce("payload", F.lit(""))
    size = F.octet_length(F.encode(payload, "UTF-8")).cast("string")
    return rows.select(
        "key", record_id(F.lit("response"), F.coalesce(F.col("key").cast("string"), F.lit("")), uri, digest(payload)).alias("record_id"),
        uri.alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n")).alias("http_headers"),
        payload.alias("payload"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two records per response: ``key, record_type, record_id, refers_to, target_uri, date, content_type, block, block_digest, payload_digest, content_length``.

    The metadata block is lines ``name: value`` with the source's digest, length and HTTP headers; the conversion block
    is the plain text. Empty pages give an empty conversion. Rows that repeat a response repeat its records.
    """
    rows = records.withColumn("source_digest", digest(F.col("payload")))
    headers = F.regexp_replace(F.regexp_replace("http_headers", r"\r\n$", ""), "\r\n", "\r\nhttp-header: ")
    metadata = F.concat(
        F.lit("source-payload-digest: "), F.col("source_digest"), F.lit("\r\nsource-payload-length: "),
        F.octet_length(F.encode("payload", "UTF-8")).cast("string"), F.lit("\r\nhttp-header: "), headers, F.lit("\r\n"),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    out = rows.select("*", F.inline(made))
    return out.select(
        "key", "record_type", record_id(F.col("record_type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "date", "content_type", "block", digest(F.col("block")).alias("block_digest"), F.col("source_digest").alias("payload_digest"),
        F.octet_length(F.encode("block", "UTF-8")).cast("long").alias("content_length"),
    )


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", " ")


def write_records(records: DataFrame, path: str) -> None:
    """Derived records as gzipped WARC files; every task writes its own."""
    fields = (
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", _one_line(F.col("target_uri"))), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("WARC-Source-Payload-Digest", F.col("payload_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    )
    head = F.concat(F.lit(f"{VERSION}\r\n"), *(F.concat(F.lit(f"{n}: "), v, F.lit("\r\n")) for n, v in fields), F.lit("\r\n"))
    records.select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: ``headers MAP, block``; the stated length must agree with the block, else the job fails."""
    raw = spark.read.option("lineSep", RECORD_BREAK).text(path)
    value = F.regexp_replace(F.regexp_replace("value", f"^{VERSION}\r\n", ""), f"{RECORD_END}$", "")
    at = F.instr(value, RECORD_END)
    head, rest = F.substr(value, F.lit(1), at - 1), F.substr(value, at + len(RECORD_END))
    pairs = F.transform(F.split(head, "\r\n"), lambda line: F.struct(F.substring_index(line, ": ", 1), F.regexp_replace(line, r"^[^:]*: ?", "")))
    parsed = raw.select(F.map_from_entries(pairs).alias("headers"), rest.alias("rest"))
    stated = F.element_at("headers", "Content-Length").cast("long")
    # Text sources cut nothing inside a record, so the rest is the block.
    agrees = F.octet_length(F.encode("rest", "UTF-8")) == stated
    return parsed.select("headers", F.when(agrees, F.col("rest")).otherwise(F.raise_error(F.lit("record length and block disagree"))).alias("block"))
