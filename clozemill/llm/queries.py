"""One query per operator over the shared tables, with its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clozemill.llm import (
    align,
    byte_bpe,
    decontaminate,
    embeddings,
    fim,
    packing,
    pii,
    quality,
    simhash,
    tokens,
    toxicity,
    url_rules,
    warc,
)
from clozemill.llm.common import crc_of_id

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_pii(spark, sf_dir):
    docs = texts(spark, sf_dir)
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans")


@query
def op2_decontamination(spark, sf_dir):
    judged = decontaminate.decontaminate(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated"
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op2_decontamination"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS key
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
),
met AS (SELECT r, k, g.n, item FROM grams g JOIN win USING (key) WHERE g.n = win.n),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + met.n)) AS place FROM met) GROUP BY r),
named AS (SELECT r, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT r, item FROM met WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


PREFIX_RULES = (
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
)
#: What the method itself blocks where no rule of the list fits.
SPAM_WORDS = ("bets", "casino", "pills", "poker")


@query
def op3_url_rules(spark, sf_dir):
    rules = [url_rules.parse(r, rank=1) for r in PREFIX_RULES]
    rules += [url_rules.host_word("block", w) for w in SPAM_WORDS]
    names = [r.name for r in rules if not r.pattern]
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    listed = F.when(F.col("rule").isin(names), F.col("rule")).alias("rule")
    return judged.select("page_id", "host", "path", listed, "verdict")


_RULE_ROWS = ", ".join(
    f"('{host}', '/{path}', '{host}/{path}', '{verdict}')"
    for verdict, host, path in (
        (r.split(" ")[0], *r.split(" ")[1].split("/", 1)) for r in PREFIX_RULES
    )
)
ORACLES["op3_url_rules"] = rf"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
rules(h, p, name, said) AS (VALUES {_RULE_ROWS}),
best AS (
  SELECT r, arg_max(name, length(name)) AS name, arg_max(said, length(name)) AS said
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY r
)
SELECT page_id, host, path, name AS rule,
  coalesce(said, CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(SPAM_WORDS)})([.-]|$)')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (r)
"""


@query
def op4_quality(spark, sf_dir):
    docs = texts(spark, sf_dir)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query
def op5_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op5_embeddings"] = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
  SELECT a, min(b) AS component_id FROM r GROUP BY a
),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN reach ON vec_id = reach.a LEFT JOIN n ON vec_id = n.a
"""


@query
def op6_warc(spark, sf_dir):
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))).drop("source_headers")


def _op6_oracle() -> str:
    """Patterns of RE2, written for themselves; entities of the tables only, & last."""
    quoted = """"[^"]*"|''[^'']*''"""
    attributes = f"""(?:[^>"'']|{quoted})*"""
    hidden = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script[^>]*>|\z)"
    aside = "(?is)" + "|".join(rf"<{x}\b.*?(?:</{x}[^>]*>|\z)" for x in ("style", "title", "noscript", "template"))
    blocks = (
        "address|article|aside|blockquote|body|br|caption|center|dd|div|dl|dt|fieldset|figure|figcaption|footer|form|"
        "h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul"
    )
    # RE2 has no look-ahead: what follows the name of a tag is a blank, a slash or its end.
    block = rf"(?i)</?(?:{blocks})(?:[^a-z0-9>-]{attributes})?>"
    value = rf"""(?:{quoted}|[^\s"''>][^\s>]*)"""
    link = rf"""(?is)<a(?:[\s/]+[^\s/>="''][^\s/>=]*(?:\s*=\s*{value})?)*?[\s/]+href\s*=\s*({value})"""
    title = r"(?is)<title\b[^>]*>(.*?)(?:</title|\z)"
    no_date = "1970-01-01T00:00:00Z"
    named = {"&copy;": "\u00a9", "&middot;": "\u00b7", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0", "&amp;": "&"}

    def decoded(x):
        for name, letter in named.items():
            x = f"replace({x}, '{name}', '{letter}')"
        return x

    def uuid(*parts):
        h = f"sha256(concat_ws(chr(1), {', '.join(parts)}))"
        cut = [f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return f"'<urn:uuid:' || concat_ws('-', {', '.join(cut)}) || '>'"

    crlf = "chr(13) || chr(10)"
    blanks = "[\\t\\n\\x0B\\f\\r \u00a0]+"
    text = f"regexp_replace(visible, '{aside}', ' ', 'g')"
    text = f"regexp_replace({text}, '{block}', chr(1), 'g')"
    text = f"regexp_replace({text}, '(?is)</?[a-z!?](?:{attributes}>|[^>]*(?:>|\\z))', '', 'g')"
    text = f"regexp_replace({decoded(text)}, '{blanks}', ' ', 'g')"
    text = f"trim(regexp_replace({text}, ' ?\\x01[ \\x01]*', chr(10), 'g'), ' ' || chr(10))"
    one = lambda x: f"trim(regexp_replace({decoded(x)}, '[\\x00-\\x20\u00a0]+', ' ', 'g'))"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: '
  || CAST(octet_length(CAST(encode(html) AS BLOB)) AS VARCHAR) || {crlf} AS http, 'sha256:' || sha256(html) AS payload FROM p),
b AS (SELECT *, 'sha256:' || sha256(http || {crlf} || html) AS blockd FROM h),
i AS (SELECT *, {uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "uri", f"'{no_date}'", "blockd")} AS id,
  regexp_replace(html, '{hidden}', ' ', 'g') AS visible FROM b),
k AS (SELECT *, {uuid("'metadata'", "id")} AS mid, {uuid("'conversion'", "id")} AS tid, {text} AS body FROM i),
m AS (SELECT *, 'title: ' || {one(f"regexp_extract(visible, '{title}', 1)")} || {crlf} || 'conversion: ' || tid || {crlf}
  || 'source-payload-digest: ' || payload || {crlf} || 'source-block-digest: ' || blockd || {crlf}
  || 'source-header: HTTP/1.1 200 OK' || {crlf} || 'source-header: Content-Type: text/html; charset=utf-8' || {crlf}
  || 'source-header: Content-Length: ' || CAST(octet_length(CAST(encode(html) AS BLOB)) AS VARCHAR) || {crlf}
  || array_to_string(list_transform(regexp_extract_all(visible, '{link}', 1), lambda x: 'outlink: ' || {one("regexp_replace(x, '(?s)^[' || chr(34) || chr(39) || '](.*)[' || chr(34) || chr(39) || ']$', '" + chr(92) + "1')")} || {crlf}), '') AS about FROM k),
r AS (
  SELECT page_id, 'metadata' AS warc_type, mid AS record_id, id AS refers_to, tid AS concurrent_to, uri, 'application/warc-fields' AS content_type, payload, about AS block FROM m
  UNION ALL
  SELECT page_id, 'conversion', tid, id, mid, uri, 'text/plain; charset=utf-8', payload, body FROM m
)
SELECT page_id, warc_type, record_id, refers_to, concurrent_to, uri AS target_uri, '{no_date}' AS date, content_type,
  CAST(octet_length(CAST(encode(block) AS BLOB)) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest,
  payload AS source_digest, block,
  'WARC/1.1' || {crlf} || 'WARC-Type: ' || warc_type || {crlf} || 'WARC-Record-ID: ' || record_id || {crlf}
  || 'WARC-Refers-To: ' || refers_to || {crlf} || 'WARC-Concurrent-To: ' || concurrent_to || {crlf}
  || 'WARC-Target-URI: ' || uri || {crlf} || 'WARC-Date: {no_date}' || {crlf}
  || 'WARC-Block-Digest: sha256:' || sha256(block) || {crlf} || 'Content-Type: ' || content_type || {crlf}
  || 'Content-Length: ' || CAST(octet_length(CAST(encode(block) AS BLOB)) AS VARCHAR) || {crlf} AS headers
FROM r
"""


ORACLES["op6_warc"] = _op6_oracle()


@query
def op7_toxicity(spark, sf_dir):
    docs = texts(spark, sf_dir)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


@query
def op8_token_counts(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.token_counts(texts(spark, sf_dir), path).drop("text")


@query
def op9_packing(spark, sf_dir):
    return packing.pack(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(texts(spark, sf_dir))


@query
def op11_byte_bpe(spark, sf_dir):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.encode(texts(spark, sf_dir), path, pattern, keep_text=False)
    return byte_bpe.digests(rows, path)


@query
def op12_token_alignment(spark, sf_dir):
    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(texts(spark, sf_dir), a, b)


@query
def op13_fill_in_middle(spark, sf_dir):
    rows = fim.restored(fim.transform(fim.framed(texts(spark, sf_dir))))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


ORACLES["op13_fill_in_middle"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substring(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
  FROM documents
),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
p AS (
  SELECT *, substring(text, 1, lo) AS pre, substring(text, lo + 1, hi - lo) AS mid, substring(text, hi + 1, n - hi) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
