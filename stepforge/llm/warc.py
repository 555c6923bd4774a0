"""WARC derivatives: linked metadata and plain-text conversion records of response records.

``read_responses`` takes the response records of WARC files, ``responses`` gives pages the form of such records (HTTP
headers and payload); ``derive`` turns response records into one metadata and one conversion record each. Both refer to
the response by its record id and target, keep its date, carry its payload digest and HTTP headers (metadata block), and
name each other. Record ids are name-based: a rerun makes the same records. ``write_records`` writes them as WARC files.
Nothing is shuffled; the markup of a payload is read once, in an Arrow UDF, and the records are built by column functions.

Defined results: a null payload is empty; a null url is the empty target; markup that never closes is text, but for the
opening tag itself; a hidden element ends at the first closing tag of its own name; repeated rows give repeated records,
and other rows of one page id and url get records of their own, as the id is made from the payload's digest too; line
breaks in urls are percent-encoded; numeric and the listed named character references are decoded once, others stay as
they are; a payload is read whole whatever its size, in time that grows with its length; an empty table gives an empty
one; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PARSED = StructType([StructField(name, StringType()) for name in ("text", "title", "lang")])

# Named character references, elements that are not shown, and elements that stand on lines of their own.
REFERENCES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "amp": "&"}
HIDDEN = ("noscript", "script", "style", "template")
BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 head header hr li main nav ol p pre section table td th title tr ul".split())

_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
_HEAD = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?])")
_LANG = re.compile(r"\blang=\"([A-Za-z-]+)\"", re.I)
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9A-Fa-f]+)|(" + "|".join(REFERENCES) + "));")
_MANY = re.compile(" {2,}")
_BREAK = re.compile(" ?\n[ \n]*")


def _character(found: re.Match) -> str:
    decimal, hexadecimal, name = found.groups()
    if name:
        return REFERENCES[name]
    digits = (decimal or hexadecimal).lstrip("0")
    code = int(digits or "0", 10 if decimal else 16) if len(digits) <= 7 else -1
    return chr(code) if 32 <= code < 0xD800 or 0xE000 <= code < 0x110000 else found[0]


def visible(html: str) -> tuple[str, str, str]:
    """The text, title and language of a page, in one walk over its tags."""
    for blank in "\t\r\n\f":
        html = html.replace(blank, " ")
    out, at, title, lang, open_ended = [], 0, None, "", set()
    spot = html.find("<")
    while spot >= 0:
        head = _HEAD.match(html, spot)
        if head is None:
            spot = html.find("<", spot + 1)
            continue
        comment, closing, name = head.groups()
        end, mark = -1, ""
        if comment:
            if comment not in open_ended and (end := html.find("-->", spot + 4)) < 0:
                open_ended.add(comment)
            end, mark = (end + 3, " ") if end >= 0 else (-1, "")
        if end < 0:
            if (end := html.find(">", head.end())) < 0:
                break
            end += 1
            if name:
                name = name.lower()
                mark = "\n" if name in BLOCKS else ""
                if not closing and name in _CLOSING and name not in open_ended:
                    if over := _CLOSING[name].search(html, end):
                        end, mark = over.end(), " "
                    else:
                        open_ended.add(name)
                elif not closing and name == "title" and title is None:
                    over = html.find("<", end)
                    title = html[end : over if over >= 0 else len(html)]
                elif not closing and name == "html" and not lang and (found := _LANG.search(html, spot, end)):
                    lang = found[1]
        out += (html[at:spot], mark)
        at = end
        spot = html.find("<", at)
    out.append(html[at:])
    text, title = "".join(out), title or ""
    if "&" in text:
        text = _REFERENCE.sub(_character, text)
    if "&" in title:
        title = _REFERENCE.sub(_character, title)
    return _BREAK.sub("\n", _MANY.sub(" ", text)).strip(" \n"), _MANY.sub(" ", title).strip(" "), lang


@F.arrow_udf(PARSED)
def _parsed(payload: pa.Array) -> pa.Array:
    columns = list(zip(*(visible(x.as_py()) for x in payload))) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], PARSED.names)


def record_id(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(digest, a, n), F.lit("-" if a < 21 else ">"))])


def _digest(block: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_id, target_uri, date, http_headers, payload: the response record of each page."""
    payload, url = F.coalesce("html", F.lit("")), _one_line(F.coalesce("url", F.lit("")))
    http = F.concat(F.lit(CRLF.join(("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "))), F.octet_length("payload").cast("string"))
    own = pages.select("page_id", url.alias("target_uri"), payload.alias("payload")).withColumn("sha", F.sha2("payload", 256))
    own_id = record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"), F.col("sha"))
    return own.select("page_id", own_id.alias("record_id"), "target_uri", F.lit(date).alias("date"), http.alias("http_headers"), "payload")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """page_id (null), record_id, target_uri, date, http_headers, payload, whole: the response records of WARC files.

    Files are cut at the blank lines and version lines between records, so large ones are split among tasks. Bytes that
    are not UTF-8 become replacement characters. ``whole`` is false where the block has not the length that its header
    tells: the file is damaged, or a block holds a blank line and a version line itself.
    """
    raw = spark.read.option("lineSep", "\r\n\r\nWARC/1.").text(path).filter("length(value) > 0")
    parts = F.split("value", CRLF + CRLF, 3)
    rows = raw.select("value", parts[0].alias("head"), parts[1].alias("http_headers"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("rest"))
    last = F.endswith("rest", F.lit(CRLF + CRLF))
    field = lambda name: F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    size = F.octet_length("value") - F.octet_length("head") - 4
    length = field("Content-Length").try_cast("long")
    payload = F.when(last & (size - 4 == length), F.expr("left(rest, length(rest) - 4)")).otherwise(F.col("rest"))
    rows = rows.filter(F.lower(field("WARC-Type")) == "response")
    return rows.select(F.lit(None).cast("long").alias("page_id"), field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"), F.coalesce("http_headers", F.lit("")).alias("http_headers"), payload.alias("payload"), F.coalesce((size == length) | (last & (size - 4 == length)), F.lit(False)).alias("whole"))


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, record_type, record_id, refers_to, target_uri, payload_digest, block, record."""
    own = records.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", F.coalesce("payload", F.lit("")).alias("payload"))
    own = own.select("page_id", "refers_to", "target_uri", "date", "http_headers", F.octet_length("payload").cast("string").alias("size"), _digest("payload").alias("payload_digest"), _parsed("payload").alias("page"))
    own = own.withColumn("conversion_id", record_id(F.lit("conversion"), F.col("refers_to"))).withColumn("metadata_id", record_id(F.lit("metadata"), F.col("refers_to")))
    fields = [("title", F.col("page.title")), ("languages-html", F.col("page.lang")), ("conversion-record", F.col("conversion_id")), ("source-payload-digest", F.col("payload_digest")), ("source-payload-length", F.col("size")), ("text-length", F.octet_length("page.text").cast("string"))]
    block = F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))], F.regexp_replace(F.concat(F.lit(CRLF), F.col("http_headers"), F.lit(CRLF)), r"\r\n(?=[^\r\n])", CRLF + "source-http: "))
    kinds = [("metadata", "metadata_id", "application/warc-fields", block), ("conversion", "conversion_id", "text/plain; charset=utf-8", F.col("page.text"))]
    made = F.array(*[F.struct(F.lit(kind).alias("record_type"), F.col(name).alias("id"), F.lit(content).alias("content_type"), body.alias("block")) for kind, name, content, body in kinds])
    rows = own.select("page_id", "target_uri", "date", "payload_digest", "refers_to", F.explode(made).alias("r")).select("*", "r.*", _digest("r.block").alias("block_digest"))
    names = [("WARC-Type", "record_type"), ("WARC-Record-ID", "id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type")]
    record = F.concat(F.lit("WARC/1.1" + CRLF), *[x for name, column in names for x in (F.lit(f"{name}: "), F.col(column), F.lit(CRLF))], F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF + CRLF))
    return rows.select("page_id", "record_type", F.col("id").alias("record_id"), "refers_to", "target_uri", "payload_digest", "block_digest", "block", record.alias("record"))


def write_records(derived: DataFrame, path: str) -> None:
    """WARC files of the records, one file a task."""
    derived.select(F.expr("left(record, length(record) - 4)")).write.option("lineSep", CRLF + CRLF).text(path)


def digests(derived: DataFrame) -> DataFrame:
    return derived.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", F.octet_length("block").cast("long").alias("content_length"), F.sha2("record", 256).alias("record_sha256"))
