"""WARC derivatives: metadata and plain-text conversion records from response records.

Pages are read in Arrow batches, in forward passes that look at no stretch of a page more than a few times, whatever the
markup: an opener behind which no closer stands is decided once for all that follow. The rest is SQL functions. Digests are labelled SHA-256 in
hexadecimal; record ids are URNs made from an MD5 of what the record is and where it comes from, so that a repeated run
writes the same ids.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitrace.llm.batches import bound_batches

CRLF = "\r\n"
#: Elements that end a line of text.
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
_S = r"[ \t\n\x0b\f\r]"
_FLAGS = re.IGNORECASE | re.ASCII
#: What hides its content, and its end.
_HIDING = re.compile(r"<(?:script|style|!--)", _FLAGS)
_ENDS = {"script": re.compile(rf"</script{_S}*+>", _FLAGS), "style": re.compile(rf"</style{_S}*+>", _FLAGS), "!--": re.compile("-->")}
#: The source's own white space; a lone blank stays as it is, so the pattern finds only the runs that change.
_SOURCE_SPACE = re.compile(r"[\t\n\f\r\x0B][\t\n\f\r \x0B]*+| [\t\n\f\r \x0B]++")
_BLOCK = re.compile(rf"</?(?:{_BLOCKS})(?:{_S}[^>]*+|/)?>", _FLAGS)
_TAG = re.compile(r"<[^>]*+>")
_TITLE, _TITLE_END = re.compile(r"<title", _FLAGS), re.compile(r"</title", _FLAGS)
_SPACES = re.compile(rf"{_S}+")
#: A character reference in text, and one in an attribute: there a name without semicolon ends before "=" and letters.
_IN_TEXT = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)")
_IN_VALUE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{1,31}(?:;|(?![=A-Za-z0-9])))")
#: White space that a reference stands for is a blank in text, and line ends and tabs are dropped from links.
_BLANKS = {ord(c): " " for c in "\t\n\x0b\f\r\xa0"}
_NOT_IN_LINKS = dict.fromkeys(map(ord, "\t\n\r"))
#: An anchor, an attribute href in it, and the attribute's value without quotes.
_ANCHOR, _HREF = re.compile(rf"<a{_S}", _FLAGS), re.compile(rf"""(?<=[ \t\n\x0b\f\r"'/])href{_S}*+={_S}*+""", _FLAGS)
_BARE = re.compile(r"""[^ \t\n\x0b\f\r"'>]+""")
#: Then white space: runs of blanks to one, blanks around line ends away, line ends to one.
_SPACE_STEPS = (
    (re.compile(r"[\t\f\r\x0B][\t\f\r \x0B]*+| [\t\f\r \x0B]++"), " "), (re.compile(r" \n[ \n]*+|\n[ \n]++"), "\n"),
)


def resolve(text: str) -> str:
    """``text`` with all named and numeric character references of HTML resolved, once."""
    return _IN_TEXT.sub(lambda m: unescape(m.group()).translate(_BLANKS), text) if "&" in text else text


def resolve_link(value: str) -> str:
    """The link that an attribute's value, with its quotes if any, stands for."""
    if value[:1] in ('"', "'"):
        value = value[1:-1]
    if "&" not in value:
        return value
    return _IN_VALUE.sub(lambda m: (unescape(m.group()) if m[0][1] == "#" else html5.get(m[0][1:], m[0])).translate(_NOT_IN_LINKS), value)


def without_hidden(html: str) -> str:
    """``html`` with scripts, styles and comments as blanks; one that never ends stays."""
    out, at, endless = [], 0, set()
    for m in _HIDING.finditer(html):
        kind = m.group()[1:].lower()
        if m.start() < at or kind in endless:
            continue
        begin = m.end() if kind == "!--" else html.find(">", m.end()) + 1
        end = _ENDS[kind].search(html, begin) if begin else None
        if end is None:
            endless.add(kind)  # nor does one that begins later
            continue
        out += [html[at : m.start()], " "]
        at = end.end()
    return "".join([*out, html[at:]]) if out else html


def _replaced(pattern: re.Pattern, new: str, text: str) -> str:
    """Tags replaced; behind the last ``>`` there is none."""
    cut = text.rfind(">") + 1
    return pattern.sub(new, text[:cut]) + text[cut:]


def page_text(html: str) -> str:
    """The visible text of a page, one line per block."""
    text = _SOURCE_SPACE.sub(" ", without_hidden(html))
    text = resolve(_replaced(_TAG, "", _replaced(_BLOCK, "\n", text)))
    for pattern, new in _SPACE_STEPS:
        text = pattern.sub(new, text)
    return text.strip(" \n")


def page_title(html: str) -> str:
    """The content of the first title; one that never ends is none."""
    m = _TITLE.search(html)
    begin = html.find(">", m.end()) + 1 if m else 0
    end = _TITLE_END.search(html, begin) if begin else None
    return _SPACES.sub(" ", resolve(html[begin : end.start()])).strip(" ") if end else ""


def page_links(html: str) -> list[str]:
    """The values of the first href of all anchors. Of an anchor's tag all is looked at once: where it has none, an anchor that
    begins inside it has none either."""
    out, at, unclosed = [], 0, {}
    while m := _ANCHOR.search(html, at):
        stop = html.find(">", m.end())
        stop = len(html) if stop < 0 else stop
        at = stop
        for name in _HREF.finditer(html, m.end(), stop):
            begin, quote = name.end(), html[name.end() : name.end() + 1]
            if quote in ('"', "'") and quote:
                end = -1 if begin >= unclosed.get(quote, len(html)) else html.find(quote, begin + 1)
                if end < 0:
                    unclosed[quote] = min(begin, unclosed.get(quote, begin))
                    continue
                end += 1
            else:
                bare = _BARE.match(html, begin)
                if bare is None:
                    continue
                end = bare.end()
            out.append(resolve_link(html[begin:end]))
            at = end
            break
    return out


@F.arrow_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())]))
def _read(pages: pa.Array) -> pa.Array:
    html = pages.to_pylist()
    made = [pa.array([page_title(h) for h in html], pa.string()), pa.array([page_links(h) for h in html], pa.list_(pa.string())), pa.array([page_text(h) for h in html], pa.string())]
    return pa.StructArray.from_arrays(made, names=["title", "links", "text"])


def _digest(column):
    return F.concat(F.lit("sha256:"), F.sha2(column.cast("binary"), 256))


def _urn(*parts):
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, crawl_date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages: ``page_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest``.

    Null html is an empty payload, null url an empty target. The record id comes from page id, target and digest.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    base = pages.select(
        "page_id", url.alias("target_uri"), F.lit(crawl_date).alias("warc_date"), html.alias("payload"), _digest(html).alias("payload_digest"),
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
            F.octet_length(html).cast("string"), F.lit(CRLF),
        ).alias("http_headers"),
    )
    return base.withColumn("record_id", _urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", "payload_digest"))


def derivatives(records: DataFrame) -> DataFrame:
    """A ``metadata`` and a ``conversion`` record for every response record.

    Columns: ``page_id, warc_type, record_id, refers_to, target_uri, warc_date, content_type, source_headers,
    source_digest, block_digest, content_length, content``. ``refers_to`` is the response's record id, and the source's
    HTTP headers and payload digest go along unchanged. The metadata content is warc-fields: the title, the number of
    links, and an ``outlink`` line per link in page order. Character references are resolved in text, title and links.
    Responses that repeat give records that repeat with the same ids. An empty payload gives an empty conversion and a
    metadata record without links; an empty table gives nothing. Other columns of ``records`` are ignored, and none of
    their names clashes with what is made here. A page is worked on whole, however long. Malformed markup is read the
    same way: a script, style or comment that never ends is text from its tag on, a ``<`` without a ``>`` is text, an
    anchor without href is no link, and a title that never ends is none.
    """
    bound_batches(records.sparkSession)
    told = records.withColumn("__page", _read(F.coalesce("payload", F.lit(""))))
    told = told.withColumns({"__title": F.col("__page.title"), "__links": F.col("__page.links"), "__text": F.col("__page.text")})
    lines = F.concat(
        F.lit("title: "), "__title", F.lit(f"{CRLF}link-count: "), F.size("__links").cast("string"), F.lit(CRLF),
        F.array_join(F.transform("__links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), lines.alias("content")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("__text").alias("content")),
    )
    return (
        told.select("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest", F.explode(made).alias("r"))
        .select(
            "page_id", "r.warc_type", _urn(F.col("r.warc_type"), "record_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri",
            "warc_date", "r.content_type", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"),
            _digest(F.col("r.content")).alias("block_digest"), F.octet_length("r.content").cast("long").alias("content_length"), "r.content",
        )
    )


def record_text(record: dict) -> bytes:
    """One derivative record (a row as a dict) in WARC/1.0 form."""
    body = record["content"].encode()
    head = [
        "WARC/1.0", f"WARC-Type: {record['warc_type']}", f"WARC-Record-ID: {record['record_id']}", f"WARC-Refers-To: {record['refers_to']}",
        f"WARC-Target-URI: {record['target_uri']}", f"WARC-Date: {record['warc_date']}", f"WARC-Block-Digest: {record['block_digest']}",
        f"Content-Type: {record['content_type']}", f"Content-Length: {len(body)}", "", "",
    ]
    return CRLF.join(head).encode() + body + (CRLF * 2).encode()
