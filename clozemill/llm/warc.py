"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives two records. The metadata record lists title, links and the
response's own headers and digests; the conversion record holds the plain text.
Both name the response in WARC-Refers-To, keep its target and date, and name
each other, so any of the three leads to the others. Identifiers are hashes of
what a record says, so a recomputed task gives the same ones.

All work stays in the row, in DataFrame functions; there is no shuffle.

Rows: a null address becomes an empty one, a null page an empty payload; both
still give two records. Repeated rows give equal records with equal identifiers.
An empty table gives an empty result. Only the columns named as keys are kept
of the input.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date of responses whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"

_END = r"\z"
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: What no reader sees, and whole elements that are no part of the text. The first
#: character stands alone, so that other places are passed over at once.
_HIDDEN = rf"(?is)<(?:!--.*?(?:-->|{_END})|script\b.*?(?:</script[^>]*>|{_END}))"
_ASIDE = (
    rf"(?is)<(?:style\b.*?(?:</style[^>]*>|{_END})|title\b.*?(?:</title[^>]*>|{_END})"
    rf"|noscript\b.*?(?:</noscript[^>]*>|{_END})|template\b.*?(?:</template[^>]*>|{_END}))"
)
_BLOCKS = (
    "address|article|aside|blockquote|body|br|caption|center|dd|div|dl|dt|fieldset|figure|figcaption|footer|form|"
    "h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul"
)
_BLOCK_TAG = rf"(?i)</?(?:{_BLOCKS})(?![a-z0-9-]){_ATTRIBUTES}>"
#: Any tag, or what is left of one that a cut page never closes.
_TAG = rf"(?is)</?[a-z!?](?:{_ATTRIBUTES}>|[^>]*(?:>|{_END}))"
#: Runs of blanks other than one space, which already is what it should be.
_BLANK = "[\\t\\n\\x0B\\f\\r \\u00a0]"
_BLANKS = f"{_BLANK}(?:(?<=[^ ]){_BLANK}*+|{_BLANK}++)"
#: Stands for the break of a block until blanks are folded; a page has no such character.
_BREAK = "\u0001"
_ENTITY = r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"
_TITLE = rf"(?is)<title\b[^>]*>(.*?)(?:</title|{_END})"
#: The first href of an anchor, with its quotes if it has some; quoted values of other attributes are passed over whole.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_NEXT = r"""(?:[\s/]++|(?<=["']))"""
_LINK = (
    rf"(?is)<a(?=[\s/])(?:{_NEXT}(?!href[\s=])[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?)*+"
    rf"{_NEXT}href\s*+=\s*+({_VALUE})"
)
_QUOTED = r"""(?s)^(["'])(.*)\1$"""
_CRLF = "\r\n"


def _character(entity: Column) -> Column:
    """The character of one entity with its & and ;, or the entity as it is."""
    named = F.create_map(
        *[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (f"&{name};", chr(code))],
        F.lit("&apos;"),
        F.lit("'"),
    )
    digits = F.regexp_extract(entity, "^&#(?:[xX])?([0-9A-Fa-f]+);$", 1)
    code = F.when(entity.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numbered = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(entity.startswith("&#"), F.when(valid, numbered)).otherwise(F.try_element_at(named, entity))


def unescaped(text: Column) -> Column:
    """Entities as characters, each once; unknown ones stay."""
    parts = F.arrays_zip(
        F.split(text, _ENTITY, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)).alias("entity"),
    )
    whole = F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(p["gap"], F.coalesce(_character(p["entity"]), p["entity"], F.lit(""))),
        ),
        "",
    )
    return F.when(text.contains("&"), whole).otherwise(text)


def with_plain_text(df: DataFrame, html: str, text: str = "text") -> DataFrame:
    """Adds the text of a page: blocks on lines of their own, blanks folded, no empty lines.

    Adds __visible, too, the page without comments and scripts. Each step is a
    column, so that a step which names its input several times computes it once.
    """
    seen = df.withColumn("__visible", F.regexp_replace(F.col(html), _HIDDEN, " "))
    body = F.regexp_replace("__visible", _ASIDE, " ")
    bare = F.regexp_replace(F.regexp_replace(body, _BLOCK_TAG, _BREAK), _TAG, "")
    folded = F.regexp_replace(unescaped(F.col("__bare")), _BLANKS, " ")
    lines = F.regexp_replace(folded, f" ?{_BREAK}[ {_BREAK}]*", "\n")
    return (
        seen.withColumn("__bare", bare)
        .withColumn(text, F.btrim(lines, F.lit(" \n")))
        .drop("__bare")
    )


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(unescaped(text), "[\\x00-\\x20\\u00a0]+", " "))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def identifier(*parts: Column) -> Column:
    """A UUID from a hash of all parts."""
    h = F.substring(F.sha2(F.concat_ws("\u0001", *parts).cast("binary"), 256), F.lit(1), F.lit(32))
    dashed = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def responses(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: Column | None = None,
) -> DataFrame:
    """Response records of pages: (key, record_id, target_uri, date, http_headers, payload, digests)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias(key),
        F.coalesce(F.col(url), F.lit("")).alias("target_uri"),
        (F.lit(NO_DATE) if date is None else date).alias("date"),
        F.concat(
            F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
            F.octet_length(payload).cast("string"),
            F.lit(_CRLF),
        ).alias("http_headers"),
        payload.alias("payload"),
        digest(payload).alias("payload_digest"),
    )
    block = F.concat("http_headers", F.lit(_CRLF), "payload")
    key_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return rows.withColumn("block_digest", digest(block)).withColumn(
        "record_id", identifier(F.lit("response"), key_text, F.col("target_uri"), F.col("date"), F.col("block_digest"))
    )


def derivatives(found: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The metadata and conversion records of response records.

    One row per record: keys, warc_type, record_id, refers_to, target_uri, date,
    content_type, content_length (bytes), block_digest, source_headers,
    source_digest (of the response's payload), headers (the whole WARC header)
    and block.
    """
    sources = [*keys, "record_id", "target_uri", "date", "http_headers", "payload_digest", "block_digest"]
    rows = with_plain_text(found.select(*sources, "payload"), "payload").select(
        *sources,
        "text",
        F.regexp_extract("__visible", _TITLE, 1).alias("title"),
        F.regexp_extract_all("__visible", F.lit(_LINK), F.lit(1)).alias("links"),
    )
    meta_id = identifier(F.lit("metadata"), F.col("record_id"))
    text_id = identifier(F.lit("conversion"), F.col("record_id"))
    links = F.transform(
        "links",
        lambda x: F.concat(F.lit("outlink: "), one_line(F.regexp_replace(x, _QUOTED, "$2")), F.lit(_CRLF)),
    )
    source = F.transform(
        F.filter(F.split("http_headers", _CRLF, -1), lambda x: x != ""),
        lambda x: F.concat(F.lit("source-header: "), x, F.lit(_CRLF)),
    )
    about = F.concat(
        _header("title", one_line(F.col("title"))),
        _header("conversion", text_id),
        _header("source-payload-digest", F.col("payload_digest")),
        _header("source-block-digest", F.col("block_digest")),
        F.array_join(source, ""),
        F.array_join(links, ""),
    )

    def record(kind: str, own_id: Column, other_id: Column, content: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            own_id.alias("record_id"),
            other_id.alias("concurrent_to"),
            F.lit(content).alias("content_type"),
            block.alias("block"),
        )

    both = F.array(
        record("metadata", meta_id, text_id, "application/warc-fields", about),
        record("conversion", text_id, meta_id, "text/plain; charset=utf-8", F.col("text")),
    )
    source_columns = [
        *keys,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("http_headers").alias("source_headers"),
        F.col("payload_digest").alias("source_digest"),
    ]
    out = rows.select(*source_columns, F.explode(both).alias("r")).select(
        *keys,
        "r.warc_type",
        "r.record_id",
        "refers_to",
        "r.concurrent_to",
        "target_uri",
        "date",
        "r.content_type",
        F.octet_length("r.block").cast("bigint").alias("content_length"),
        digest(F.col("r.block")).alias("block_digest"),
        "source_headers",
        "source_digest",
        "r.block",
    )
    headers = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _header("WARC-Type", F.col("warc_type")),
        _header("WARC-Record-ID", F.col("record_id")),
        _header("WARC-Refers-To", F.col("refers_to")),
        _header("WARC-Concurrent-To", F.col("concurrent_to")),
        _header("WARC-Target-URI", F.col("target_uri")),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Block-Digest", F.col("block_digest")),
        _header("Content-Type", F.col("content_type")),
        _header("Content-Length", F.col("content_length").cast("string")),
    )
    return out.withColumn("headers", headers)


def serialized(records: DataFrame) -> Column:
    """A record as it stands in a WARC file."""
    return F.concat(records["headers"], F.lit(_CRLF), records["block"], F.lit(_CRLF * 2))
