"""The DuckDB SQL that every query is compared with.

Written apart from the Spark code: word boundaries are marked characters
instead of look-arounds, alignments are joins, and sequences are recursive.
"""

from __future__ import annotations

from checks.views import duck_with
from clozemill import fixed_values as fv

_WS = fv.WHITESPACE
_LIST = lambda items: "(" + ", ".join("'" + i + "'" for i in items) + ")"
_STOP = _LIST(fv.STOP_WORDS)
_CANON = "'generate question: context: ' || context || ' answer: ' || answer"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


# --- corpora -----------------------------------------------------------------

_CANONICAL = f"""
canonical as (
  select row_idx,
    case when row_idx % 3 = 0
      then 'talks-' || sha256(context || chr(1) || question || chr(1) || answer)
      else id end as example_id,
    context, answer as answer_text, question, {_CANON} as source, question as target,
    'talks' as dataset_name, 'xx' as language
  from (select row_idx, id, {_collapse('context')} as context,
          {_collapse('question')} as question, {_collapse('answer')} as answer from v_qa_flat)
  where context <> '' and question <> '' and answer <> '')"""

_NESTED = f"""
nested as (
  select pos as row_idx,
    case when q_idx % 3 = 0 then 'nested-' || pos else id end as example_id,
    context, answer as answer_text, question, {_CANON} as source, question as target,
    'nested' as dataset_name, 'xx' as language, title
  from (
    select *, row_number() over (order by conv_id, q_idx) - 1 as pos
    from (
      select q.conv_id, q.row_idx as q_idx, q.id, {_collapse('c.context')} as context,
        {_collapse('q.question')} as question, {_collapse('q.answer')} as answer,
        't' || q.conv_id as title
      from v_qa_flat q join (
        select conv_id, arg_min(context, row_idx) as context from v_qa_flat group by 1
      ) c on c.conv_id = q.conv_id)
    where context <> '' and question <> '' and answer <> ''))"""

_QA = duck_with("v_qa_flat")

# --- answers -----------------------------------------------------------------

_SENTENCES = f"""
pieces as (
  select doc_id, list_filter(string_split(
    regexp_replace({_collapse('text')}, '([.!?]) ', '\\1' || chr(3), 'g'), chr(3)),
    lambda x: x <> '') as l
  from v_texts),
sents as (
  select doc_id, unnest(l) as sentence, cast(generate_subscripts(l, 1) - 1 as int) as sent_idx
  from pieces),
marked as (
  select *, regexp_replace(sentence, '[\\p{{L}}\\p{{N}}_]+', chr(1) || '\\0' || chr(2), 'g') as m
  from sents)"""

_CAP = r"\x01[A-ZА-ЯЁ][A-Za-zЀ-ӿ\-\x01\x02]*"
_NAME = rf"\x04?{_CAP}(?: +{_CAP}){{0,4}}[\x01\x02]"
_STRIP = "' ' || chr(9) || chr(13) || chr(10) || ',.;:!?()[]{}'"


def _found(expression: str) -> str:
    """Cleaned, valid matches of a list of raw ones."""
    return (
        f"list_filter(list_transform({expression}, "
        "lambda x: trim(regexp_replace(x, '[\\x01\\x02\\x04]', '', 'g'), " + _STRIP + ")), "
        f"lambda x: length(x) between 2 and 90 and lower(x) not in {_STOP} "
        "and regexp_matches(x, '[\\p{L}\\p{Nd}]'))"
    )


_DATES = (
    r"(?i)\x01(\p{Nd}{1,2}\x02 +\x01[Ѐ-ӿ]{3,12}\x02 +\x01\p{Nd}{4})\x02",
    r"(?i)\x01(\p{Nd}{4}(?:\x02 *\x01)?(?:год[ауе]?|век[ауе]?|г|вв?))\x02",
    r"(?i)\x01(\p{Nd}+(?:\x02[,.]\x01\p{Nd}+)?"
    r"(?:\x02 *%\x01|(?:\x02 *\x01)?(?:km|m|cm|kg|g|mln|million|billion)\x02))",
)
# A name at the start of a sentence carries chr(4); alone, it is not reported.
_OPENINGS = (
    "regexp_replace(regexp_replace(m, '^\\x01', chr(4) || chr(1)), "
    "'([.!?])\\x01', '\\1' || chr(4) || chr(1), 'g')"
)
_NAMES = (
    f"list_filter(regexp_extract_all({_OPENINGS}, '{_NAME}', 0), "
    "lambda x: not (x[1] = chr(4) and not contains(x, ' ')))"
)


def _phrases(n: int) -> str:
    words = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return (
        f"list_filter(list_transform(range(1, len(w) - {n} + 2), lambda i: {words}), "
        "lambda x: x is not null and length(x) <= 90)"
    )


_LISTS = {
    "quoted": f"""{_found("regexp_extract_all(sentence, '" + fv.QUOTED_PATTERN + "', 1)")}""",
    "dates_and_numbers": "list_concat("
    + ", ".join(_found(f"regexp_extract_all(m, '{p}', 1)") for p in _DATES)
    + ")",
    "abbreviations": _found(
        r"regexp_extract_all(m, '\x01([A-ZА-ЯЁ]{2,}(?:\x02-\x01[A-ZА-ЯЁ]{2,})?)\x02', 1)"
    ),
    "proper_names": _found(_NAMES),
    "key_phrases": f"list_concat({_phrases(3)}, {_phrases(2)}, {_phrases(1)})",
}

_LISTED = (
    "listed as (select *, list_transform(regexp_extract_all(sentence, '"
    + fv.WORD_PATTERN
    + f"'), lambda x: case when length(x) >= 5 and lower(x) not in {_STOP} then x end) as w "
    "from marked)"
)


def _extractor(name: str) -> str:
    return (
        duck_with("v_texts") + "," + _SENTENCES + ",\n" + _LISTED + ",\n"
        f"f as (select doc_id, sent_idx, {_LISTS[name]} as l from listed)\n"
        "select doc_id, sent_idx, cast(generate_subscripts(l, 1) - 1 as int) as match_idx, "
        "unnest(l) as answer_text from f"
    )


_KINDS = (
    ("quoted", "'quoted'", "4.0"),
    ("dates_and_numbers", "'date_or_number'", "3.7"),
    ("abbreviations", "'abbreviation'", "3.4"),
    ("proper_names", "'proper_name'", "3.0"),
    ("key_phrases", "'keyword'", "1.0 + 0.2 * len(string_split(t, ' '))"),
)
_CANDIDATES = (
    _SENTENCES + ",\n" + _LISTED + ",\n"
    "candidates as (" + "\nunion all ".join(
        f"select doc_id, sent_idx, sentence, {i} as ext, idx, t, {kind} as kind, "
        f"cast({score} as double) as score from (select doc_id, sent_idx, sentence, "
        f"unnest(l) as t, generate_subscripts(l, 1) as idx from "
        f"(select doc_id, sent_idx, sentence, {_LISTS[name]} as l from listed))"
        for i, (name, kind, score) in enumerate(_KINDS)
    ) + """),
placed as (
  select *, lower(t) as k,
    row_number() over (partition by doc_id order by sent_idx, ext, idx) as place from candidates),
keyed as (
  select *, row_number() over (partition by doc_id, k order by score desc, place) as rn,
    min(place) over (partition by doc_id, k) as first_place from placed),
distinct_answers as (
  select doc_id, row_number() over (partition by doc_id order by score desc, first_place) as rank,
    t as answer_text, kind as answer_kind, round(score, 1) as answer_score,
    sentence as source_sentence
  from keyed where rn = 1)"""
)
_ANSWERS = duck_with("v_texts") + "," + _CANDIDATES

# --- questions ---------------------------------------------------------------

_FACT = (
    "regexp_replace(regexp_replace(replace(source_sentence, answer_text, '_____'), "
    f"'^{_WS}+|{_WS}+$', '', 'g'), '[.!?]+$', '')"
)


def _question() -> str:
    cases = []
    for kind, (with_fact, without_fact) in fv.QUESTION_TEXTS.items():
        text = f"'{without_fact}' || answer_text || '?'"
        if with_fact:
            text = f"case when fact <> '' then '{with_fact}' || fact || '?' else {text} end"
        cases.append(f"else {text} end" if kind == "other" else f"when '{kind}' then {text}")
    return "case answer_kind " + " ".join(cases)


def _templated(view: str) -> str:
    return f"select *, {_question()} as template from (select *, {_FACT} as fact from {view})"


def _clean(c: str) -> str:
    return _collapse(f"replace({c}, '<extra_id_0>', '')")


def _valid(c: str) -> str:
    c = f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
    return (
        f"(length({c}) >= 5 and regexp_matches({c}, '\\p{{L}}') "
        f"and lower({c}) not in {_LIST(fv.EMPTY_PROMPTS)})"
    )


_MODEL = _clean("model_question")

# --- scores ------------------------------------------------------------------


def _tokens_13a(c: str) -> str:
    line = f"regexp_replace({c}, '{_WS}+$', '')"
    for old, new in (
        ("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ):
        line = f"replace({line}, '{old}', '{new}')"
        if old == "<skipped>":
            line = f"replace(replace({line}, '-' || chr(10), ''), chr(10), ' ')"
    line = f"' ' || {line} || ' '"
    for pattern, replacement in (
        (r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        line = f"regexp_replace({line}, '{pattern}', '{replacement}', 'g')"
    return f"string_split({_collapse(line)}, ' ')"


def _rouge_tokens(c: str, letters: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace(lower({c}), '[^{letters}]+', ' ', 'g'), ' '), "
        "lambda x: x <> '')"
    )


def _grams(n: int) -> str:
    parts = " || chr(1) || ".join(f"w[i + {k}]" for k in range(n))
    return f"unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: {parts}))"


def _overlaps(view: str, key: str, by: str, tokens, orders: int) -> str:
    """tok, grams and hits: clipped n-gram matches per pair and order."""
    return f"""
tok as (
  select {key}, {by}, 1 as p, {tokens('prediction')} as w from {view}
  union all select {key}, {by}, 0, {tokens('reference')} from {view}),
grams as ({' union all '.join(
    f'select {key}, {by}, p, {n} as n, {_grams(n)} as g from tok' for n in range(1, orders + 1))}),
clipped as (
  select {key}, {by}, n, g, least(sum(p), sum(1 - p)) as hit, sum(p) as np, sum(1 - p) as nr
  from grams group by all),
hits as (
  select {key}, {by}, n, sum(hit) as hit, sum(np) as np, sum(nr) as nr from clipped group by all)"""


def _bleu(view: str, key: str, by: str) -> str:
    return _overlaps(view, key, by, _tokens_13a, 4) + f""",
orders4 as (
  select {by}, n, sum(hit) as hit, sum(np) as np, sum(nr) as nr from hits group by all),
smoothed as (
  select *, sum(case when hit = 0 then 1 else 0 end) over (partition by {by} order by n) as zeros
  from orders4),
bleu as (
  select {by}, round(case when max(case when n = 1 then hit end) > 0 and count(*) = 4 then
      (case when max(case when n = 1 then np end) >= max(case when n = 1 then nr end) then 1.0
        else exp(1 - max(case when n = 1 then nr end) / max(case when n = 1 then np end)) end)
      * exp(avg(ln(case when hit = 0 then 100.0 / (pow(2.0, zeros) * np)
                   else 100.0 * hit / np end)))
    else 0.0 end, 6) as sacrebleu
  from smoothed group by all),
sizes as (select {by}, count(*) as num_examples from {view} group by all)"""


def _rouge(view: str, key: str, by: str, letters: str) -> str:
    return (
        duck_with(view) + ","
        + _overlaps(view, key, by, lambda c: _rouge_tokens(c, letters), 2)
        + f""",
f as (select {key}, {by}, n, case when hit > 0 then 2.0 * hit / (np + nr) else 0.0 end as f
      from hits)
select v.{by}, cast(count(*) / 2 as bigint) as num_examples,
  round(avg(coalesce(f, 0.0)) filter (o.n = 1), 6) as rouge1,
  round(avg(coalesce(f, 0.0)) filter (o.n = 2), 6) as rouge2
from {view} v cross join (values (1), (2)) o(n)
  left join f on f.{key} = v.{key} and f.n = o.n
group by 1"""
    )


# From which 16-bit number on a Poisson weight of mean one is at least 1, 2, 3, …
_POISSON = "[24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535]"


def _replicates(view: str) -> str:
    """w: the weight of every pair in 1000 replicates, eight to an MD5."""
    return f"""
drawn as (
  select pair_id, lang, c, md5(pair_id || ':' || c || ':0') as h
  from {view} cross join (select unnest(range(0, 125)) as c)),
w as (
  select pair_id, lang, 8 * c + k as replicate,
    len(list_filter({_POISSON}, lambda s: s <= cast('0x' || substring(h, 1 + 4 * k, 4) as int))) as w
  from drawn cross join (select unnest(range(0, 8)) as k))"""


def _interval(name: str) -> str:
    return ", ".join(
        f'round(quantile_cont({name}, {q}), 6) as "{name}_{side}"'
        for side, q in (("low", 0.025), ("mid", 0.5), ("high", 0.975))
    )


# Predictions of v_pairs leave out words only, so their longest common subsequence is all of them.
_BOOTSTRAP_ROUGE = (
    duck_with("v_pairs") + ","
    + _overlaps("v_pairs", "pair_id", "lang", lambda c: _rouge_tokens(c, "a-z0-9"), 2)
    + f""",
f as (
  select v.pair_id, v.lang,
    coalesce(max(case when n = 1 and hit > 0 then 2.0 * hit / (np + nr) end), 0.0) as rouge1,
    coalesce(max(case when n = 2 and hit > 0 then 2.0 * hit / (np + nr) end), 0.0) as rouge2,
    coalesce(max(case when n = 1 and np > 0 then 2.0 * np / (np + nr) end), 0.0) as rougel
  from v_pairs v left join hits using (pair_id, lang) group by all),
{_replicates("v_pairs")},
sums as (
  select lang, replicate, count(*) as num_examples, sum(w * rouge1) / sum(w) as rouge1,
    sum(w * rouge2) / sum(w) as rouge2, sum(w * rougel) / sum(w) as "rougeL"
  from w join f using (pair_id, lang) group by all having sum(w) > 0)
select lang, max(num_examples) as num_examples, {_interval("rouge1")}, {_interval("rouge2")}, {_interval("rougeL")}
from sums group by lang"""
)

_BOOTSTRAP_BLEU = (
    duck_with("v_pairs") + ","
    + _overlaps("v_pairs", "pair_id", "lang", _tokens_13a, 4)
    + f""",
counts as (
  select pair_id, lang, {', '.join(f"coalesce(max(case when n = {n} then {c} end), 0) as {c}{n}" for n in (1, 2, 3, 4) for c in ("hit", "np", "nr"))}
  from v_pairs left join hits using (pair_id, lang) group by all),
{_replicates("v_pairs")},
sums as (
  select lang, replicate, count(*) as num_examples, {', '.join(f"sum(w * {c}{n}) as {c}{n}" for n in (1, 2, 3, 4) for c in ("hit", "np", "nr"))}
  from w join counts using (pair_id, lang) group by all having sum(w) > 0),
zeros as (
  select *, {', '.join(f"(hit{n} = 0)::int" + "".join(f" + (hit{k} = 0)::int" for k in range(1, n)) + f" as z{n}" for n in (1, 2, 3, 4))} from sums),
scores as (
  select lang, num_examples, case when hit1 > 0 and np4 > 0 then
    (case when np1 >= nr1 then 1.0 else exp(1 - nr1 / np1) end)
    * exp(({' + '.join(f"ln(case when hit{n} = 0 then 100.0 / (pow(2.0, z{n}) * np{n}) else 100.0 * hit{n} / np{n} end)" for n in (1, 2, 3, 4))}) / 4)
    else 0.0 end as sacrebleu
  from zeros)
select lang, max(num_examples) as num_examples, {_interval("sacrebleu")} from scores group by lang"""
)


def _feistel(source: str, name: str, sizes: str, back: bool) -> str:
    """One pass of the keyed rounds over a column x of ``source``, with a and b its grid and k its keys."""
    steps, last = [], source
    for j, i in enumerate(reversed(range(8)) if back else range(8)):
        other = "y" if i % 2 else "l"
        mixed = f"((({other} + k[{2 * i + 1}]) % 2147483647) * (({other} + k[{2 * i + 1}]) % 2147483647) % 2147483647 * k[{2 * i + 2}] % 2147483647)"
        sign = "-" if back else "+"
        half = f"(l {sign} {mixed} % a + a) % a as l, y" if i % 2 else f"l, (y {sign} {mixed} % b + b) % b as y"
        split = "x // b as l, x % b as y" if j == 0 else "l, y"
        steps.append(f"select * exclude (l, y), {half} from (select * exclude ({'x' if j == 0 else 'l, y'}), {split} from ({last}))")
        last = steps[-1]
    return f"select * exclude (l, y), l * b + y as x from ({last})"


_KEYS = "list_transform(range(0, 16), lambda i: case when i % 2 = 0 then cast('0x' || substring(md5(seed || ':' || (i // 2)), 1, 8) as bigint) % 2147483647 else 1 + cast('0x' || substring(md5(seed || ':' || (i // 2)), 9, 8) as bigint) % 2147483646 end)"

_SHUFFLED_PLACES = f"""
with recursive rows as (
  select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents),
seeded as (
  select *, {_KEYS} as k, cast(floor(sqrt(n - 1)) as bigint) + 1 as a
  from rows cross join (values (7), (42)) s(seed)),
sized as (select *, (n + a - 1) // a as b, i as x from seeded),
walk as (
  {_feistel("select * from sized", "x", "", False)}
  union all
  {_feistel("select * from walk where x >= n", "x", "", False)})
select seed, doc_id, x // 32 as batch_id, cast(x % 32 as int) as batch_pos, i as row_at_slot from walk where x < n"""

_TURN_PAIRS = duck_with("v_turn_pairs") + f""",
turns as (
  select row_idx, 1 as everything, {_collapse('prediction')} as prediction,
    {_collapse('reference')} as reference
  from v_turn_pairs)"""

_LCS = f"""
p as (select row_idx, {_rouge_tokens('prediction', 'a-z0-9')} as a,
        {_rouge_tokens('reference', 'a-z0-9')} as b from turns),
r as (
  select row_idx, a, b, 0 as i, [0::bigint for k in range(0, len(b) + 1)] as prev from p
  union all
  select row_idx, a, b, i + 1,
    list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]),
      lambda cur, jj: list_append(cur,
        case when b[jj[1]] = a[i + 1] then prev[jj[1]] + 1
          else greatest(prev[jj[1] + 1], cur[-1]) end), [0::bigint])
  from r where i < len(a)),
lcs as (
  select row_idx, case when prev[-1] > 0 then 2.0 * prev[-1] / (len(a) + len(b)) else 0.0 end as f
  from r where i = len(a))"""


def _meteor(view: str, key: str, by: str) -> str:
    """Words are paired by their rank from the end; chunks are breaks in both orders."""
    pattern = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _WS[1:]

    def words(c: str) -> str:
        return f"regexp_extract_all(lower({c}), '{pattern}')"

    return f"""
words as (
  select {key}, {by}, {words('prediction')} as a, {words('reference')} as b
  from {view}),
pw as (select {key}, unnest(a) as t, generate_subscripts(a, 1) as i from words),
rw as (select {key}, unnest(b) as t, generate_subscripts(b, 1) as j from words),
pr as (select *, row_number() over (partition by {key}, t order by i desc) as k from pw),
rr as (select *, row_number() over (partition by {key}, t order by j desc) as k from rw),
aligned as (select pr.{key}, i, j from pr join rr on pr.{key} = rr.{key} and pr.t = rr.t
              and pr.k = rr.k),
steps as (
  select *, case when i - lag(i) over o = 1 and j - lag(j) over o = 1 then 0 else 1 end as chunk
  from aligned window o as (partition by {key} order by i)),
counts as (select {key}, count(*) as m, sum(chunk) as c from steps group by 1),
meteor_pairs as (
  select w.{key}, w.{by}, case when m > 0 then
      (1 - 0.5 * pow(c / m, 3)) * (m / len(a)) * (m / len(b))
        / (0.9 * m / len(a) + 0.1 * m / len(b)) else 0.0 end as meteor
  from words w left join counts n on n.{key} = w.{key})"""


def _stems(words: str) -> str:
    """From the table ``words`` (word) a table ``stems`` (word, stem): one step after another."""

    def rest(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def measure(n: int) -> str:
        shape = f"left(sh, length(w) - {n})"
        return f"(length({shape}) - length(replace({shape}, '01', ''))) // 2"

    def short(n: int) -> str:
        shape = f"left(sh, length(w) - {n})"
        return f"({shape} = '01' or {shape} like '%101' and substr(w, length(w) - {n}, 1) not in ('w', 'x', 'y'))"

    def rules(pairs, least: int | None, more=lambda ending: "") -> str:
        cases = ""
        for ending, new in pairs:
            kept = 1 if ending == "logi" else len(ending)  # it is measured with its "log"
            fits = "true" if least is None else f"{measure(kept)} > {least}"
            cases += f" when w like '%{ending}' then case when {fits}{more(ending)} then {rest(len(ending))} || '{new}' else w end"
        return f"case{cases} else w end"

    def ion(ending: str) -> str:
        return " and substr(w, length(w) - 3, 1) in ('s', 't')" if ending == "ion" else ""

    repaired = " or ".join(f"w like '%{old}'" for old, _ in fv.STEM_REPAIRS)
    steps = [
        f"case when length(w) = 4 and w like '%ies' then {rest(1)} else {rules(fv.STEM_PLURALS, None)} end",
        f"""case when w like '%ied' then case when length(w) = 4 then {rest(1)} else {rest(2)} end
          when w like '%eed' then case when {measure(3)} > 0 then {rest(1)} else w end
          when w like '%ed' and contains(left(sh, length(w) - 2), '0') then chr(1) || {rest(2)}
          when w like '%ing' and contains(left(sh, length(w) - 3), '0') then chr(1) || {rest(3)} else w end""",
        f"""case when not cut then w when {repaired} then w || 'e'
          when right(w, 1) = substr(w, length(w) - 1, 1) and length(w) > 1 and right(sh, 1) = '1'
            then case when right(w, 1) in ('l', 's', 'z') then w else {rest(1)} end
          when {measure(0)} = 1 and {short(0)} then w || 'e' else w end""",
        f"case when length(w) > 2 and w like '%y' and substr(sh, length(w) - 1, 1) = '1' then {rest(1)} || 'i' else w end",
        f"case when w like '%alli' and {measure(4)} > 0 then {rest(2)} else w end",
        rules(fv.STEM_DOUBLE, 0),
        rules(fv.STEM_SINGLE, 0),
        rules([(e, "") for e in fv.STEM_LAST], 1, ion),
        f"case when w like '%e' and ({measure(1)} > 1 or {measure(1)} = 1 and not {short(1)}) then {rest(1)} else w end",
        f"case when w like '%ll' and {measure(1)} > 1 then {rest(1)} else w end",
    ]
    shape = (
        "list_reduce(list_prepend('', string_split(w, '')), lambda s, c: s || case when c in ('a', 'e', 'i', 'o', 'u') "
        "or c = 'y' and right(s, 1) = '1' then '0' else '1' end)"
    )
    chain = f"select word, word as w from {words} where length(word) > 2"
    for step in steps:
        chain = f"""select word, {step} as w from (
  select *, {shape} as sh from (
  select word, starts_with(w, chr(1)) as cut, ltrim(w, chr(1)) as w from ({chain})))"""
    known = " ".join(f"when '{word}' then '{stem}'" for word, stem in fv.STEM_IRREGULAR.items())
    return f"""
stems as (
  select a.word, case a.word {known} else coalesce(c.w, a.word) end as stem
  from {words} a left join ({chain}) c on c.word = a.word)"""


def _tokens(c: str) -> str:
    pattern = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + _WS[1:]
    return f"regexp_extract_all(lower({c}), '{pattern}')"


def _meteor_by_stems() -> str:
    """The exact pairs, then the words left over by their rank among those of one stem."""
    exact = _meteor("v_pairs", "pair_id", "lang")
    head, tail = exact.split("aligned as (", 1)
    return head + "exact as (" + tail.replace("steps as (", f"""every as (
  select distinct t as word from (select t from pw union all select t from rw)),{_stems("every")},
lp as (
  select p.pair_id, p.i, s.stem, row_number() over (partition by p.pair_id, s.stem order by p.i desc) as k
  from pw p join stems s on s.word = p.t anti join exact e on e.pair_id = p.pair_id and e.i = p.i),
lr as (
  select r.pair_id, r.j, s.stem, row_number() over (partition by r.pair_id, s.stem order by r.j desc) as k
  from rw r join stems s on s.word = r.t anti join exact e on e.pair_id = r.pair_id and e.j = r.j),
aligned as (
  select pair_id, i, j from exact
  union all select lp.pair_id, lp.i, lr.j from lp join lr
    on lr.pair_id = lp.pair_id and lr.stem = lp.stem and lr.k = lp.k),
steps as (""", 1)


def _cell(c: str) -> str:
    text = f"coalesce({c}::varchar, '')"
    return f"""case when regexp_matches({text}, '[",\n\r]') then '"' || replace({text}, '"', '""') || '"' else {text} end"""


# --- runs --------------------------------------------------------------------

_PICKED = duck_with("v_experiments", "v_configs", "v_run_metrics", "v_summaries") + """,
asked(g, group_pos) as (
  values ('BUILDING', 0), ('NO SUCH GROUP', 1), ('MACHINERY', 2), ('BUILDING', 3)),
picked as (select a.group_pos, e.* from v_experiments e join asked a on a.g = e."group"),
summary as (
  select group_pos, pos, id, title, coalesce(scenario, '') as scenario, model_family,
    coalesce(model_name, config_model_name) as model_name, train_language, eval_language,
    dataset, p.config, c.output_dir, c.output_dir || '/checkpoints/best' as checkpoint,
    best_val_loss, coalesce(elapsed_hms, '') as elapsed_hms, coalesce(device, '') as device,
    num_examples, sacrebleu, "rougeL", meteor
  from picked p join v_configs c on c.config = p.config
    left join v_run_metrics m on m.output_dir = c.output_dir
    left join v_summaries s on s.output_dir = c.output_dir)"""
_EVERY_RUN = _PICKED.replace(
    "values ('BUILDING', 0), ('NO SUCH GROUP', 1), ('MACHINERY', 2), ('BUILDING', 3)",
    "values ('MACHINERY', 0), ('AUTOMOBILE', 1), ('BUILDING', 2), ('HOUSEHOLD', 3), ('FURNITURE', 4)",
)
_CELLS = _EVERY_RUN + """,
cells as (
  select group_pos, pos, id, scenario, model_name, train_language, eval_language,
    coalesce(printf('%.4f', sacrebleu), '') as sacrebleu,
    coalesce(printf('%.4f', "rougeL"), '') as "rougeL",
    coalesce(printf('%.4f', meteor), '') as meteor, '' as bertscore_f1,
    coalesce(printf('%.4f', best_val_loss), '') as best_val_loss from summary)"""

_STOPPING = duck_with("v_epochs") + """,
run_epochs as (
  select run_id, list(epoch order by epoch) as e, list(val_loss order by epoch) as v
  from v_epochs group by 1),
walk as (
  select run_id, patience, e, v, 0 as i, 'inf'::double as best, null::int as best_epoch, 0 as waited
  from run_epochs cross join (values (0), (1), (2), (3)) p(patience)
  union all
  select run_id, patience, e, v, i + 1, least(best, v[i + 1]),
    case when v[i + 1] < best then e[i + 1] else best_epoch end,
    case when v[i + 1] < best then 0 else waited + 1 end
  from walk where i < len(e) and waited < greatest(patience, 1))
select run_id, patience, cast(i as bigint) as epochs_run, e[i] as stop_epoch, best_epoch,
  best as best_val_loss, waited >= greatest(patience, 1) as stopped_early
from walk where i = len(e) or waited >= greatest(patience, 1)"""

# --- batches -----------------------------------------------------------------

_SPLIT = "list_filter(string_split({}, ' '), lambda x: x <> '')"
_BATCHED = f"""
limited as (
  select row_idx, {_SPLIT.format('source')} as s, {_SPLIT.format('target')} as t
  from canonical)"""

_BATCH_IDS = (
    "cast(floor((row_number() over (order by row_idx) - 1) / 4) as bigint) as batch_id, "
    "cast((row_number() over (order by row_idx) - 1) % 4 as int) as batch_pos"
)

_SHUFFLED = "order by ('0x' || substr(md5(row_idx || ':42'), 1, 15))::bigint, row_idx"


ORACLES: dict[str, str] = {
    "normalize_text": f"""
select 'd' as kind, doc_id as id, {_collapse('text')} as text from documents
union all select 'p', page_id, {_collapse('html')} from pages""",
    "repair_mojibake": duck_with("v_ru_facts") + """
select 'broken' as kind, doc_id, text from v_ru_facts
union all select 'intact', doc_id, text from v_ru_facts
union all select 'latin', doc_id, 'Р ' || text from documents""",
    "falsy_to_empty": """
select l_orderkey, l_linenumber,
  case when l_discount = 0 then '' else cast(l_discount as varchar) end as number,
  cast(floor(l_extendedprice) * 4096.0::double as varchar) as large,
  cast(l_quantity::double / 65536.0::double as varchar) as small,
  case when l_returnflag = 'R' then 'True' else '' end as flag,
  case when l_returnflag = 'R' then l_linestatus else '' end as text from lineitem""",
    "build_source": _QA + f"\nselect row_idx, {_CANON} as source from v_qa_flat",
    "first_answer": _QA + f"""
select layout, row_idx,
  case when layout in ('empty', 'text') then '' else {_collapse('answer')} end as answer_text
from v_qa_flat cross join
  (values ('struct'), ('structs'), ('list'), ('empty'), ('text')) l(layout)""",
    "drop_incomplete": duck_with("v_turns") + """
select row_idx, id from v_turns
where context <> '' and question <> '' and answer <> ''""",
    "normalize_qa": _QA + "," + _CANONICAL + "\nselect * from canonical",
    "flatten_qas": _QA + "," + _NESTED + "\nselect * from nested",
    "limit_first_n": _QA + "," + _CANONICAL
    + "\nselect row_idx, example_id from canonical order by row_idx limit 50",
    "union_corpora": _QA + "," + _CANONICAL + "," + _NESTED + """
select 0 as spec_pos, row_idx, example_id, dataset_name, question, null as title from canonical
union all select 1, row_idx, example_id, dataset_name, question, title from nested""",
    "split_sentences": duck_with("v_texts") + "," + _SENTENCES
    + "\nselect doc_id, sent_idx, sentence from sents",
    **{name: _extractor(name) for name in _LISTS},
    "dedup_candidates": _ANSWERS + "\nselect * from distinct_answers",
    "top_answers": _ANSWERS + "\nselect * from distinct_answers where rank <= 5",
    "docs_without_answers": _ANSWERS + """
select doc_id from v_texts where doc_id not in (select doc_id from distinct_answers)""",
    "clean_question": f"""
select conv_id, turn,
  {_clean("'<extra_id_0> ' || text || ' <extra_id_0>'")} as question
from conversations""",
    "is_valid_question": f"""
select o_orderkey, {_valid('c')} as valid from (
  select o_orderkey, case when o_orderstatus = 'F' then o_orderpriority
    when o_orderstatus = 'P' then ' Answer: '
    else cast(cast(o_totalprice as decimal(18, 2)) as varchar) end as c from orders)""",
    "template_question": duck_with("v_answers") + f"""
select doc_id, template as question from ({_templated('v_answers')})""",
    "resolve_questions": duck_with("v_answers") + f""",
r as (select *, {_MODEL} as model from ({_templated('v_answers')})),
s as (
  select r.*, strategy, strategy = 'template'
    or (strategy = 'hybrid' and not {_valid('model')}) as fallback
  from r cross join (values ('hybrid'), ('template'), ('model')) s(strategy))
select doc_id, rank, answer_text,
  case when fallback then template else model end as generated_question,
  case when strategy = 'template' then '' else model end as model_question,
  fallback as used_fallback, strategy from s""",
    "attach_model_questions": """
select l_orderkey as doc_id, l_linenumber as rank, l_partkey,
  coalesce(o_orderpriority, '') as model_question
from lineitem left join orders on o_orderkey = l_orderkey and l_linenumber = 1""",
    "text_to_questions_template": _ANSWERS + f"""
select doc_id, rank, answer_text, answer_kind, answer_score, source_sentence,
  template as generated_question, '' as model_question, true as used_fallback,
  'template' as strategy
from ({_templated('distinct_answers')}) where rank <= 5""",
    "batch_generate": _QA + "," + _CANONICAL + f""",
cut as (select row_idx, array_to_string(list_slice(string_split(source, ' '), 1, 384), ' ') as s
        from canonical)
select row_idx, length(s) || ' ' || replace(s, ' ', '_') as prediction from cut""",
    "prediction_rows": _QA + "," + _CANONICAL + """
select c.row_idx, example_id, dataset_name, c.context, answer_text,
  target as reference_question, q.question as generated_question
from canonical c join v_qa_flat q on q.row_idx = c.row_idx""",
    "align_pairs": duck_with("v_turn_pairs") + """
select row_idx, prediction, reference from v_turn_pairs""",
    "corpus_bleu": duck_with("v_pairs") + "," + _bleu("v_pairs", "pair_id", "lang") + """
select lang, num_examples, sacrebleu from sizes join bleu using (lang)""",
    "rouge_n": _rouge("v_pairs", "pair_id", "lang", "a-z0-9"),
    "rouge_n_unicode": _rouge("v_pairs", "pair_id", "lang", r"\p{L}\p{N}"),
    "bootstrap_rouge": _BOOTSTRAP_ROUGE,
    "bootstrap_bleu": _BOOTSTRAP_BLEU,
    "shuffled_places": _SHUFFLED_PLACES,
    "rouge_l": _TURN_PAIRS + "," + _LCS + """
select count(*) as num_examples, round(avg(f), 6) as "rougeL" from lcs""",
    # The prediction leaves words of its reference out, so it is their longest common part.
    "rouge_l_documents": duck_with("v_pairs") + f""",
sizes as (
  select lang, len({_rouge_tokens('prediction', 'a-z0-9')}) as p,
    len({_rouge_tokens('reference', 'a-z0-9')}) as r from v_pairs)
select lang, count(*) as num_examples,
  round(avg(case when p > 0 then 2.0 * p / (p + r) else 0.0 end), 6) as "rougeL" from sizes group by 1""",
    "rouge_lsum": _TURN_PAIRS + "," + _LCS + """
select count(*) as num_examples, round(avg(f), 6) as "rougeLsum" from lcs""",
    # A prediction's lines are lines of the reference, so every token of it is covered once.
    "rouge_lines_documents": duck_with("v_line_pairs") + ","
    + _overlaps("v_line_pairs", "pair_id", "lang", lambda c: _rouge_tokens(c, "a-z0-9"), 2)
    + """,
f as (
  select v.pair_id, v.lang,
    coalesce(max(case when n = 1 and hit > 0 then 2.0 * hit / (np + nr) end), 0.0) as rouge1,
    coalesce(max(case when n = 2 and hit > 0 then 2.0 * hit / (np + nr) end), 0.0) as rouge2,
    coalesce(max(case when n = 1 and np > 0 then 2.0 * np / (np + nr) end), 0.0) as covered
  from v_line_pairs v left join hits using (pair_id, lang) group by all)
select lang, count(*) as num_examples, round(avg(rouge1), 6) as rouge1, round(avg(rouge2), 6) as rouge2,
  round(avg(covered), 6) as "rougeL", round(avg(covered), 6) as "rougeLsum" from f group by lang""",
    "meteor_exact": duck_with("v_pairs") + "," + _meteor("v_pairs", "pair_id", "lang") + """
select lang, count(*) as num_examples, round(avg(meteor), 6) as meteor
from meteor_pairs group by 1""",
    "meteor_stems": duck_with("v_pairs") + "," + _meteor_by_stems() + """
select lang, count(*) as num_examples, round(avg(meteor), 6) as meteor
from meteor_pairs group by 1""",
    "word_stems": duck_with("v_texts") + f""",
every as (select distinct unnest({_tokens('text')}) as word from v_texts),{_stems("every")}
select word, stem from stems""",
    "embedding_match_f1": duck_with("v_token_vectors") + """,
met as (
  select p.pair_id, p.pos as i, r.pos as j,
    list_cosine_similarity(p.vec::double[], r.vec::double[]) as c
  from v_token_vectors p join v_token_vectors r on p.pair_id = r.pair_id
  where p.side = 'prediction' and r.side = 'reference'),
pr as (select pair_id, avg(c) as p from (
  select pair_id, i, max(c) as c from met group by all) group by 1),
re as (select pair_id, avg(c) as r from (
  select pair_id, j, max(c) as c from met group by all) group by 1),
scored as (
  select coalesce(p, 0) as p, coalesce(r, 0) as r, coalesce(2 * p * r / (p + r), 0) as f
  from (select distinct pair_id from v_token_vectors) left join pr using (pair_id)
    left join re using (pair_id))
select round(avg(p), 6) as bertscore_precision, round(avg(r), 6) as bertscore_recall,
  round(avg(f), 6) as bertscore_f1 from scored""",
    "safe_mean": """
select c_custkey, round(coalesce(avg(month(o_orderdate)), 0), 6) as mean_month
from customer left join orders on o_custkey = c_custkey group by 1""",
    "compute_text_metrics": _TURN_PAIRS + ","
    + _bleu("turns", "row_idx", "everything") + "," + _LCS + ","
    + _meteor("turns", "row_idx", "everything") + ","
    + _overlaps("turns", "row_idx", "everything",
                lambda c: _rouge_tokens(c, "a-z0-9"), 2)
    .replace("tok", "rtok").replace("grams", "rgrams").replace("clipped", "rclipped")
    .replace("hits", "rhits") + """,
rouge_pairs as (
  select v.row_idx, o.n, coalesce(case when hit > 0 then 2.0 * hit / (np + nr) end, 0.0) as f
  from turns v cross join (values (1), (2)) o(n)
    left join rhits h on h.row_idx = v.row_idx and h.n = o.n)
select num_examples, sacrebleu, 'orders=4|tok=13a|smooth=exp' as sacrebleu_signature,
  (select round(avg(f), 6) from rouge_pairs where n = 1) as rouge1,
  (select round(avg(f), 6) from rouge_pairs where n = 2) as rouge2,
  (select round(avg(f), 6) from lcs) as "rougeL",
  (select round(avg(f), 6) from lcs) as "rougeLsum",
  (select round(avg(meteor), 6) from meteor_pairs) as meteor
from sizes join bleu using (everything)""",
    "select_groups": _PICKED + "\nselect group_pos, pos, id, title from picked",
    "select_ids": duck_with("v_experiments") + """
select id, config from v_experiments where id in (
  select 'run-' || o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "run_summary": _EVERY_RUN + """
select *, null::double as rouge1, null::double as rouge2, null::double as "rougeLsum",
  null::double as bertscore_f1 from summary""",
    "report_cells": _CELLS + "\nselect * from cells",
    "markdown_lines": _CELLS + """
select group_pos, pos, '| ' || concat_ws(' | ', id, scenario, model_name, train_language, eval_language,
  sacrebleu, "rougeL", meteor, bertscore_f1, best_val_loss) || ' |' as value from cells
union all select -1, 0, '| id | scenario | model_name | train_language | eval_language | sacrebleu | rougeL | meteor | bertscore_f1 | best_val_loss |'
union all select -1, 1, '| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |'""",
    "csv_lines": f"""
select true as is_row, doc_id, concat_ws(',', {_cell('doc_id')}, {_cell('lang')}, {_cell('source')},
  {_cell('n_chars')}, {_cell('text')}) as value from documents
union all select false, null, chr(65279) || 'doc_id,lang,source,n_chars,text'""",
    "format_metric": """
select l_orderkey, l_linenumber,
  printf('%.4f', (l_extendedprice * l_discount - 100) / 64) as formatted from lineitem""",
    "format_hms": """
select o_orderkey, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) as hms
from (select o_orderkey, cast(floor(o_totalprice) as bigint) as s from orders)""",
    "compare_runs": duck_with("v_run_scores", "v_comparisons") + """
select comparison, left_id, right_id, round(l.sacrebleu - r.sacrebleu, 6) as sacrebleu_delta,
  round(l."rougeL" - r."rougeL", 6) as "rougeL_delta"
from v_comparisons join v_run_scores l on l.id = left_id join v_run_scores r on r.id = right_id""",
    "early_stopping": _STOPPING,
    "epoch_mean_loss": duck_with("v_steps") + """
select run_id, epoch, round(avg(loss), 6) as mean_loss from v_steps group by all""",
    "explode_training_log": duck_with("v_epochs") + """
select 'outputs/' || run_id as output_dir, epoch, val_loss, epoch * 10 as global_step
from v_epochs""",
    "human_eval_sheet": duck_with("v_ratings") + """
select *, '' as relevance_score_1_5, '' as answerability_score_1_5,
  '' as pedagogical_value_score_1_5, '' as annotator_id, '' as notes from v_ratings""",
    "human_eval_summary": duck_with("v_ratings") + """
select model, round(avg(try_cast(fluency_score_1_5 as double)), 6) as fluency,
  round(avg(try_cast(overall_score_1_5 as double)), 6) as overall from v_ratings group by 1""",
    "truncate_tokens": _QA + "," + _CANONICAL + "," + _BATCHED + """
select row_idx, array_to_string(s[1:48], ' ') as input_ids,
  array_to_string(t[1:16], ' ') as labels, len(s) > 48 or len(t) > 16 as truncated from limited""",
    "assign_batches": _QA + "," + _CANONICAL + f"\nselect row_idx, {_BATCH_IDS} from canonical",
    "shuffle_batches": _QA + "," + _CANONICAL + f"""
select row_idx, {_BATCH_IDS.replace("order by row_idx", _SHUFFLED)} from canonical""",
    "pad_batches": _QA + "," + _CANONICAL + "," + _BATCHED + f""",
b as (
  select row_idx, list_transform(s[1:48], lambda x: length(x)) as s,
    list_transform(t[1:16], lambda x: length(x)) as t, {_BATCH_IDS} from limited),
g as (select *, max(len(s)) over (partition by batch_id) as ms,
        max(len(t)) over (partition by batch_id) as mt from b)
select row_idx, batch_id, batch_pos,
  array_to_string(list_concat(s, [0 for k in range(ms - len(s))]), ' ') as input_ids,
  array_to_string(list_concat([1 for k in s], [0 for k in range(ms - len(s))]), ' ')
    as attention_mask,
  array_to_string(list_concat(t, [-100 for k in range(mt - len(t))]), ' ') as labels from g""",
}
