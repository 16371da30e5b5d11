"""WARC derivatives: metadata and plain-text conversion records of response records, linked to them."""

from __future__ import annotations

import html
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, quoted

#: Date of responses made from a table that has none; a fixed value, so that reruns agree.
EPOCH = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
#: Elements whose content is no text, and elements that end a line.
HIDDEN = ["script", "style", "noscript", "template"]
LINES = "p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre"
_END = r"(?:[\x20\t\r\n\f/][^>]*)?(?:>|\Z)"  # of a tag, after its name; a tag that is not closed runs to the end of the text
#: No pattern can fail after a long run: each match of an open comment, element or tag takes all that is left, so that time grows with the text.
_GONE = re.compile(r"(?is)<!--.*?(?:-->|\Z)|" + "|".join(rf"<{n}(?:[\x20\t\r\n\f/][^>]*)?(?:>.*?(?:</{n}{_END}|\Z)|\Z)" for n in HIDDEN))
_BREAK = re.compile(rf"(?i)</?(?:{LINES}){_END}")
_TAG = re.compile(r"<[A-Za-z/!?][^>]*(?:>|\Z)")
_TITLE = re.compile(rf"(?is)<title(?:[\x20\t\r\n\f/][^>]*)?(?:>(.*?)(?:</title{_END}|\Z)|\Z)")
RECORD = "record_id string, warc_type string, target_uri string, date string, content_type string, refers_to string, concurrent_to string, block_digest string, payload_digest string, source_status string, source_content_type string, source_headers string, content_length long, block string"


def uuid_of(*parts: Column) -> Column:
    """urn:uuid of the parts, the same in each run."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)], F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def text_and_title(page: str) -> tuple[str, str]:
    """Text and title of HTML: comments and hidden elements go, each with the closing tag of its own name; block elements end lines, tags go, references are decoded, blanks shrink.

    A tag ends at its first >. What is not closed runs to the end. A < that starts no tag is text.
    """
    shown = _GONE.sub(" ", page)
    title = _TITLE.search(shown)
    t = html.unescape(_TAG.sub("", _BREAK.sub("\n", shown)))
    t = re.sub(r" ?\n[\n ]*", "\n", re.sub("[ \t\r\xa0]+", " ", t)).strip("\n ")
    return t, " ".join(html.unescape(_TAG.sub("", title[1] or "")).split()) if title else ""


def text_of_html(page: Column) -> Column:
    """struct(text, title) of HTML; null is empty."""
    @F.pandas_udf("text string, title string")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_and_title(x or "") for x in pages], columns=["text", "title"])

    return read(page)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Response records (record_id, target_uri, date, http_headers, payload) of a table of pages. Null bodies are empty."""
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"))
    return pages.select(F.col(id_col).alias("source_id"), uuid_of(F.lit("response"), F.col(id_col), F.col(url_col)).alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), F.lit(EPOCH).alias("date"), head.alias("http_headers"), body.alias("payload"))


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, in any case; null without one."""
    v = F.regexp_extract(headers, rf"(?im)^{name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(v != "", v)


def derive(found: DataFrame) -> DataFrame:
    """Two records for each response of found(record_id, target_uri, date, http_headers, payload, ...).

    metadata: a block of fields of the source (status, headers, digest, lengths, title), concurrent to the conversion
    record. conversion: the payload's plain text. Both refer to the response by WARC-Refers-To, carry its target and
    date, its HTTP headers, and digests of their own block and of the source payload. Responses with a null payload
    give records of an empty text; null headers stay null. Repeated rows give repeated records. An empty table gives
    none. Long and broken pages take time in proportion to their length. Other columns are kept in front; one that is
    named like a field of a record comes back as source_<name>.
    """
    own = ["record_id", "target_uri", "date", "http_headers", "payload"]
    fields = [x.split()[0] for x in RECORD.split(", ")]
    extra = [c for c in found.columns if c.lower() not in own]
    # what is made below, and what stays, may not take the name of another column
    made = {*fields, "source_status", "source_content_type", "source_headers", "content_length"}
    names: list[str] = []
    for c in extra:
        names.append(free_name(f"source_{c}", [*made, *extra, *names]) if c.lower() in made else c)
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    kept = [F.struct(*(quoted(c).alias(n) for c, n in zip(extra, names, strict=True))).alias("kept")] if extra else []
    df = found.select(*kept, *own[:4], body.alias("payload")).withColumn("read", text_of_html(F.col("payload"))).withColumn("source_digest", digest(F.col("payload")))
    status = F.regexp_extract("http_headers", r"^HTTP/\S+ (\d+)", 1)
    df = df.select(*(["kept"] if extra else []), *own[:4], "read.text", "read.title", "source_digest", F.when(status != "", status).alias("status"), header(F.col("http_headers"), "content-type").alias("ctype"), F.octet_length("payload").alias("bytes"))
    field = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("")), F.lit(CRLF))
    meta = F.concat(field("source-status", F.col("status")), field("source-content-type", F.col("ctype")), field("source-length", F.col("bytes")), field("source-digest", F.col("source_digest")), field("text-length", F.octet_length("text")), field("text-digest", digest(F.col("text"))), field("title", F.col("title")))
    df = df.withColumn("meta", meta).withColumns({"mid": uuid_of(F.lit("metadata"), F.col("record_id")), "cid": uuid_of(F.lit("conversion"), F.col("record_id"))})
    kind = lambda name, ctype, me, other, block: F.struct(F.col(me).alias("record_id"), F.lit(name).alias("warc_type"), F.lit(ctype).alias("content_type"), F.col(other).alias("concurrent_to"), F.col(block).alias("block"))
    both = F.array(kind("metadata", "application/warc-fields", "mid", "cid", "meta"), kind("conversion", "text/plain; charset=utf-8", "cid", "mid", "text"))
    df = df.withColumn("r", F.explode(both))
    return df.select(
        *(["kept.*"] if extra else []), "r.record_id", "r.warc_type", "target_uri", "date", "r.content_type", F.col("record_id").alias("refers_to"), "r.concurrent_to",
        digest(F.col("r.block")).alias("block_digest"), F.col("source_digest").alias("payload_digest"), F.col("status").alias("source_status"),
        F.col("ctype").alias("source_content_type"), F.col("http_headers").alias("source_headers"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


def to_text(records: DataFrame) -> DataFrame:
    """(value) of records: each as a WARC/1.1 record with its header, block and closing blank line."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF)), F.lit(""))
    quoted = F.regexp_replace("source_headers", r"\r?\n", " | ")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Date", "date"), line("WARC-Target-URI", "target_uri"), line("WARC-Refers-To", "refers_to"),
        line("WARC-Concurrent-To", "concurrent_to"), line("WARC-Block-Digest", "block_digest"), line("WARC-Source-Payload-Digest", "payload_digest"), line("WARC-Source-Status", "source_status"), line("WARC-Source-Content-Type", "source_content_type"),
        F.coalesce(F.concat(F.lit("WARC-Source-Headers: "), quoted, F.lit(CRLF)), F.lit("")), line("Content-Type", "content_type"), line("Content-Length", "content_length"), F.lit(CRLF),
    )
    return records.select(F.concat(head, "block", F.lit(CRLF + CRLF)).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC text files, one or more a partition. Each file is a sequence of whole records."""
    to_text(records).write.option("lineSep", "\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, warc_type, target_uri, date, content_type, refers_to, block, intact) of files of write_warc.

    Files are cut at lines that start a record. intact says whether the block has the stated length and digest; a block
    that itself holds such a line is cut there and not intact.
    """
    raw = spark.read.option("lineSep", f"WARC/1.1{CRLF}").text(path).where("value <> ''")
    at = F.instr("value", CRLF + CRLF)
    df = raw.select(F.substr("value", F.lit(1), at + 1).alias("h"), F.substr("value", at + 4).alias("b"))
    get = lambda name: F.regexp_extract("h", rf"(?m)^{name}: ([^\r\n]*)\r\n", 1)
    df = df.withColumn("block", F.regexp_replace("b", r"\r\n\r\n\n?\z", ""))
    ok = (F.octet_length("block") == get("Content-Length").try_cast("long")) & (digest(F.col("block")) == get("WARC-Block-Digest"))
    names = [("record_id", "WARC-Record-ID"), ("warc_type", "WARC-Type"), ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"), ("content_type", "Content-Type"), ("refers_to", "WARC-Refers-To")]
    return df.select(*[F.when(get(n) != "", get(n)).alias(c) for c, n in names], "block", F.coalesce(ok, F.lit(False)).alias("intact"))


_HEAD = re.compile(rb"[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split(CRLF):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _response(head: dict[str, str], block: bytes, intact: bool) -> dict:
    top, _, payload = block.partition(b"\r\n\r\n")
    http = _fields(top)
    if http.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            intact = False
    charset = _CHARSET.search(http.get("content-type", ""))
    try:
        text = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    return {"record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "http_headers": top.decode("utf-8", "replace"), "payload": text, "intact": intact}


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, target_uri, date, http_headers, payload, intact) of the response records of WARC files, plain or gzip.

    Records are cut by their Content-Length: a version line inside a block does not end it. Files are read as streams, a
    record at a time; large plain files are split between tasks, and a block that holds a version line just after such a
    split is cut there and not intact. Payloads are unpacked and decoded as their HTTP headers say.
    """
    raw = spark.read.option("lineSep", "WARC/1.").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = "record_id string, target_uri string, date string, http_headers string, payload string, intact boolean"

    def run(batches):
        file, parts, head, missing = None, [], None, 0

        def close():
            block = b"".join(parts)[: int(head["content-length"])]
            return pd.DataFrame([_response(head, block, len(block) == int(head["content-length"]))])

        for pdf in batches:
            for name, piece in zip(pdf["file"], pdf["value"], strict=True):
                if head and missing > 0 and name == file:
                    parts += [b"WARC/1.", piece]
                    missing -= len(piece) + 7
                else:
                    if head and head.get("warc-type") == "response":
                        yield close()  # the file ended too soon
                    file, found = name, _HEAD.match(piece)
                    head = _fields(found[1]) if found else None
                    if not head or not head.get("content-length", "").isdigit():
                        head = None
                        continue
                    parts, missing = [piece[found.end() :]], int(head["content-length"]) - (len(piece) - found.end())
                if head and missing <= 0:
                    if head.get("warc-type") == "response":
                        yield close()
                    head = None
        if head and head.get("warc-type") == "response":
            yield close()

    return raw.mapInPandas(run, schema)
