"""The training-data operators against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from clozemill.llm import (
    decontaminate,
    embeddings,
    packing,
    pii,
    quality,
    simhash,
    tokens,
    toxicity,
    url_rules,
    warc,
)
from clozemill.llm.common import components

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word and other words, 12 of them. " * 3000
ODD = [
    (1, None), (2, ""), (3, "   \n"), (None, "No id here."), (5, "a"), (6, LONG),
    (7, "same text twice over"), (7, "same text twice over"), (8, "same text twice over"), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").repartition(3)


def empty(df):
    return df.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- components --------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + pairs[:20]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)


# --- SimHash -----------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    """Smallest id reachable, by comparing everything with everything."""
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_simhash(docs):
    rows = sorted(docs.collect())
    prints = [plain_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{p:016x}", rows[g]["doc_id"]) for r, p, g in zip(rows, prints, grouped(prints), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_simhash_links(spark):
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(8)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {
        tuple(sorted(x % (1 << 64) for x in r))
        for r in simhash.links(spark.createDataFrame(signed, "fp bigint")).collect()
    }
    listed = sorted(prints)
    want = {(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if (a ^ b).bit_count() <= 3}
    assert got == want


def test_simhash_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    empties = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert all(r["fingerprint"] == "0" * 16 and r["component_id"] == 1 for r in empties)
    assert {r["component_id"] for r in rows if r["doc_id"] in (7, 8)} == {7}
    assert simhash.near_duplicates(empty(odd)).count() == 0
    clash = odd.withColumn("fp", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("keep_id", F.lit(2))
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 5, 6, 7]
    assert {r["fp"] for r in kept.collect()} == {"mine"}


# --- quality and toxicity ----------------------------------------------------


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.01"
    d, known = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = quality.train(d, known)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = quality.score(d.select("doc_id", "text"), model).join(known, "doc_id").where(held).collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("op,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(odd, docs, labels, op, label):
    model = op.train(docs, labels)
    clash = odd.withColumn("score", F.lit("mine")).withColumn("label", F.lit(1))
    got = op.score(clash, model)
    assert [c for c in got.columns if c not in ("offending",)] == ["doc_id", "text", "label", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip() and not r["text"]}) == 1
    assert op.score(empty(odd), model).count() == 0
    # Labels that are null, repeated, of no document or of one sort only, and none at all.
    messy = labels.select("doc_id", label).union(labels.select("doc_id", label)).union(
        labels.sparkSession.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id bigint, l int")
    )
    assert op.score(odd, op.train(docs, messy)).count() == len(ODD)
    for one in (0, 1):
        same = op.train(docs, labels.where(F.col(label) == one))
        assert {r["predicted"] for r in op.score(docs, same).collect()} == {one}
    none = op.train(docs, empty(labels))
    assert op.score(docs, none).count() == docs.count()
    assert op.train(empty(docs), labels) is not None


def test_isotonic():
    raw, rate = quality.isotonic(np.array([0.0, 1, 2, 3]), np.ones(4) * 100, np.array([0.1, 0.4, 0.2, 0.9]))
    assert len(raw) == 3 and (np.diff(rate) > 0).all() and raw[1] == 1.5


def test_toxic_sentences_are_learnt_and_located(spark):
    rng = random.Random(1)
    common = ["tree", "river", "stone", "cloud", "walks", "under", "the", "a", "blue", "over"]
    rows = []
    for i in range(600):
        sentences = [" ".join(rng.choices(common, k=6)) + "." for _ in range(rng.randint(2, 6))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(sentences))
            sentences[at] = f"the {rng.choice(['vile', 'vilest', 'rotten'])} cloud walks."
        rows.append((i, " ".join(sentences), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    for r in toxicity.score(df, model).collect():
        assert r["predicted"] == r["toxic"]
        spots = [r["text"][s["start"] : s["end"]] for s in r["offending"]]
        assert all(re.search("vile|rotten", s) for s in spots) and bool(spots) == bool(r["toxic"])


# --- decontamination ---------------------------------------------------------


def plain_hits(text, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, names = low(text), set(), set()
    for item, t in items:
        w = low(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[i : i + n]:
                    hit |= set(range(k, k + n))
                    names |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(names)


ITEMS = [(1, "alpha beta"), (2, "Beta, gamma! " * 9), (10, None), (11, ""), (12, "..."), (None, "delta"), (2, "omega"), (3, "alpha beta")]
DOCS = [
    (1, "ALPHA beta x"), (2, "beta gamma " * 8 + "end"), (3, None), (4, ""), (5, "alpha\u00e9 beta alpha beta"),
    (6, "omega " * 3 + "delta " + "fill " * 100), (6, "omega"), (None, "alpha-beta"), (7, "x " * 20000 + "alpha beta"),
]


@pytest.mark.parametrize("limit", [10**6, 12])
def test_decontamination(spark, limit):
    d = spark.createDataFrame(DOCS, "doc_id bigint, text string").withColumn("items", F.lit("mine"))
    b = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.decontaminate(d, b, block_chars=limit).collect()
    assert len(got) == len(DOCS)
    for r in got:
        n, hit, names = plain_hits(r["text"], ITEMS)
        assert (r["n_words"], r["n_hit"], r["items"], r["n_items"]) == (n, hit, names, len(names))
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        cut = [r["text"][p["start"] : p["end"]] for p in r["hit_places"]]
        assert sum(len(decontaminate.words_of(c)) for c in cut) == hit
    assert decontaminate.decontaminate(empty(d), b).count() == 0
    assert {r["n_hit"] for r in decontaminate.decontaminate(d, empty(b)).collect()} == {0}


# --- personal data -----------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_pii(text):
    def good(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    found = [
        (m.start(), i, k, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if good(k, m[0])
    ]
    return sorted(found)


def test_pii_base_spans(spark, docs):
    rng = random.Random(7)
    texts = ["a@b.c@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0000001.2.3.255 256.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713",
             "\U0001f600 +442071838750 é@x.y z@x.y", "9" * 3000, "a" * 3000 + "@b", "x@y." + "a." * 2000 + "b", None, "", LONG]
    pieces = ["a", ".", "@", "b-c", "12", "4111111111111111", " ", "-", "+", "(", ")", "é", "255", "1.2.3.4", "\n", "_"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(600)]
    odd_docs = spark.createDataFrame([(i + 10**6, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    both = docs.union(odd_docs).repartition(4)
    model = pii.train(both)
    found = pii.find(both.withColumn("spans", F.lit("mine")), model)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow|Exchange hash", plan)
    rows = found.collect()
    assert len(rows) == both.count()
    for r in rows:
        want = plain_pii(r["text"])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert hashlib.sha256(joined.encode()).hexdigest() == r["base_sha256"], r["text"]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[2] == k for x in want) for k in PLAIN]
        have = [(f["start"], f["rank"], f["kind"], f["end"]) for f in r["found"]]
        assert set(want) <= set(have) and have == sorted(have)
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, k, e in have)
    assert pii.find(empty(docs), model).count() == 0
    assert not pii.train(empty(docs)).trees


def test_pii_trees_and_redaction(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        good = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        bad = ".".join(str(rng.randint(300, 999)) for _ in range(4))
        rows.append((i, f"the host {good} is up, part {bad} is not. mail joe{i}@example.com or call +1 (555) 010-{i:04d}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    model = pii.train(df)
    assert model.trees and "ip" in model.thresholds
    spaced = spark.createDataFrame(
        [(1, "the host 10 . 20 . 30 . 40 is up", 1), (2, None, 2), (3, "é mail a@b.co 1.2.3.4", 3)],
        "doc_id bigint, text string, n_chars int",
    )
    got = {r["doc_id"]: r for r in pii.redact(spaced, model, length="n_chars").collect()}
    assert got[1]["text"] == "the host [IP] is up"
    assert got[2]["text"] is None
    assert got[3]["text"] == "é mail [EMAIL] [IP]" and got[3]["n_chars"] == len(got[3]["text"])


def test_pii_generators_of_every_kind(spark):
    """No match of the e-mail and phone patterns fails its check here; the generators still act."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        number = f"{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}"
        rows.append((i, f"mail joe{i}@example.com or ann{i} (at) host (dot) org, not x{i}@y or code=b{i}@c.1 here; "
                        f"phone {number} or +1 (555) 010-{i:04d}, order {rng.randint(10**11, 10**12 - 1)} sent"))  # fmt: skip
    model = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {"email", "phone"} <= set(model.thresholds)
    texts = [(1, "mail bob (at) place (dot) net now"), (2, "mail rené.lé@place.net now"), (3, "phone 212-555-0188 now"), (4, "see x9@y now")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    assert got == {1: "mail [EMAIL] now", 2: "mail [EMAIL] now", 3: "phone [PHONE] now", 4: "see x9@y now"}


# --- tokens and packing ------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", "  a", "a  b\n \n c ", "x<|endoftext|>y <|endoftext|> z", "it's DON'T 12 3 ½ ²", "é" * 50, "a" * 4000, "日本語  한국어 😀", "\x1c a \x85\u3000b", LONG]
    letters = [*"ab '\n\t  é.9\x1c\x85s<|", "<|endoftext|>", "'re", "\u3000", "\u00a0", "word", "-"]
    return texts + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(800)]


def test_token_counts(spark, docs, library):
    texts = [*odd_texts(), None]
    d = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    rows = tokens.token_counts(d.withColumn("n_tokens", F.lit("mine")), BPE).collect()
    assert len(rows) == d.count()
    want = [len(e.ids) for e in library.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False)]
    assert [r["n_tokens"] for r in rows] == want
    assert all(r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert tokens.token_counts(empty(d), BPE).count() == 0


def check_packing(rows, texts, library, capacity=2048):
    """Every piece is there once, its ids are right, and sequences have no gaps."""
    ids = {k: [*e.ids, 0] for k, e in zip(texts, library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    seen = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for k, own in seen.items():
        own.sort()
        assert [p for p, *_ in own] == list(range(len(own)))
        assert all(n == capacity for _, _, n in own[1:]) and sum(n for *_, n in own) == len(ids[k])
    assert seen.keys() == ids.keys()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(map(len, ids.values())) // capacity)


def test_packing(spark, docs, library):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts |= {10**6 + i: t for i, t in enumerate([*odd_texts(), None])}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("length", F.lit("mine"))
    used, least = check_packing(packing.pack(d.repartition(5), BPE).collect(), texts, library)
    assert used <= least + 1
    assert packing.pack(empty(d), BPE).count() == 0


def test_packing_repeated_rows(odd):
    rows = packing.pack(odd, BPE).collect()
    assert sum(r["doc_id"] == 7 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) >= 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def exact_bins(sizes, capacity):
    """Fewest bins, by trying every open bin for every piece."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= sizes[i] and room not in rooms[:k]:
                put(i + 1, [*rooms[:k], room - sizes[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best[0]


def test_bin_completion_is_exact_on_small_cases():
    rng = random.Random(6)
    for _ in range(150):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 11))]
        counts = {n: sizes.count(n) for n in sizes}
        plan = packing.pack_counts(counts, 30)
        used = {}
        for filling, times in plan:
            assert sum(filling) <= 30
            for n in filling:
                used[n] = used.get(n, 0) + times
        assert used == counts
        assert sum(t for _, t in plan) <= exact_bins(sizes, 30) + 0


def test_steps_are_the_only_limit_of_the_search():
    rng = random.Random(16)
    for _ in range(40):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(3, 40), 12)}
        sizes = [n for n, k in counts.items() for _ in range(k)]
        plans = [packing.pack_counts(counts, 50, steps) for steps in (0, 1, 50, 100_000)]
        used = [sum(t for _, t in p) for p in plans]
        assert used == sorted(used, reverse=True) and used[0] == sum(t for _, t in packing.best_fit(counts, 50))
        for plan in plans:
            assert sorted(n for f, t in plan for n in f * t) == sorted(sizes)
    # Dominated fillings are looked at as None: 3 + 1 leaves room in which another 3 would do better.
    found = list(packing.fillings({6: 1, 4: 1, 3: 1, 1: 1}, 10))
    assert found[0] == (6, 4) and (6, 3, 1) in found and None in found


def test_bin_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 1}  # 38 of 4 x 10
    assert sum(t for _, t in packing.pack_counts(counts, 10)) == 4


# --- URL rules ---------------------------------------------------------------

RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/", "block a.b/x", "allow b/xy"]
URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/?q#f", "http://sub.www.example.com/en/x", "http://notexample.com/en/",
    "http://example.com", "http://example.com/EN/", "http://m.net/es/1", "http://net/fr/", "http://x.org/a", "ftp://a.b/xyz", "x.com/en/",
    "http://q.a.b/xy#://c.com/", "", None, "://", "http://user@example.com:80/en/", "http://casino.org/", "http://my-casino.org?x", "http://mycasino.org/",
    "a://b://c.com/en/", "http://é.com/en/\n", "http://example.com/en/" + "x" * 50000,
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    best = None
    for r in RULES:
        said, where = r.split(" ")
        h, p = where.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(where) > len(best[1])):
            best = (said, where)
    if best:
        return host, path, best[1], best[0]
    spam = "casino" in re.split("[.-]", host)
    return host, path, None, "block" if spam else "allow"


def test_url_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string").repartition(3)
    rules = [url_rules.parse(r, rank=1) for r in RULES] + [url_rules.host_word("block", "casino")]
    judged = url_rules.judge(pages, rules)
    assert not re.search("Python|Pandas|InArrow", judged._jdf.queryExecution().executedPlan().toString())
    got = judged.collect()
    assert len(got) == len(rows)
    for r in got:
        rule = r["rule"] if r["rule"] in {x.split(" ")[1] for x in RULES} else None
        assert (r["host"], r["path"], rule, r["verdict"]) == plain_verdict(r["url"]), r["url"]
    assert url_rules.judge(empty(pages), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, []).collect()} == {"allow"}


def test_url_rules_with_clashing_columns(spark, tmp_path):
    names = ["page_id", "url", "best", "__url", "Host", "VERDICT", "token", "row", "__own"]
    pages = spark.createDataFrame([(1, "http://example.com/en/1", *"abcdefg"), (2, None, *"abcdefg")], ", ".join(f"`{n}` {'bigint' if n == 'page_id' else 'string'}" for n in names))
    rules = [url_rules.parse(r, rank=1) for r in RULES]
    judged = url_rules.judge(pages, rules)
    assert judged.columns == ["page_id", "url", "best", "__url", "token", "row", "__own", "host", "path", "rule", "verdict"]
    judged.write.parquet(f"{tmp_path}/judged")
    got = by_id(spark.read.parquet(f"{tmp_path}/judged").withColumnRenamed("page_id", "doc_id"))
    assert (got[1]["verdict"], got[1]["rule"], got[1]["best"], got[1]["row"]) == ("block", "example.com/en/", "a", "f")
    assert (got[2]["verdict"], got[2]["host"], got[2]["token"]) == ("allow", "", "e")


# --- WARC --------------------------------------------------------------------

PAGES = [
    (1, "http://a.b/", "<html><head><title>T &amp; U</title><script>var x='</p>';</script></head><body><p>One &lt;two&gt;<br>three<b>four</b></p>"
        "<!-- <p>no</p> --><a class=x href=\"/q?a=1&amp;b=2\">link</a> &#233;&#x1F600; &nosuch; &amp;lt;</body></html>"),
    (2, None, None), (3, "", ""), (4, "http://x/", "<p>cut <a href='u"), (5, "http://y/", "plain & simple < 3"),
    (6, "http://z/", "<!-- never closed <p>x"), (7, "http://l/", "<p>" + LONG + "</p>"), (1, "http://a.b/", "<p>again</p>"), (None, "http://n/", "<p>no id</p>"),
]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("block", F.lit("mine"))
    found = warc.responses(pages)
    sources = {r["record_id"]: r for r in found.collect()}
    assert len(sources) == len(PAGES)
    rows = warc.derivatives(found).collect()
    assert len(rows) == 2 * len(PAGES) and len({r["record_id"] for r in rows}) == len(rows)
    texts = {}
    for r in rows:
        source = sources[r["refers_to"]]
        assert r["target_uri"] == source["target_uri"] and r["source_digest"] == source["payload_digest"]
        assert r["source_headers"] == source["http_headers"] and r["date"] == source["date"]
        assert r["content_length"] == len(r["block"].encode())
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        for line in (f"WARC-Type: {r['warc_type']}", f"WARC-Refers-To: {r['refers_to']}", f"Content-Length: {r['content_length']}"):
            assert f"\r\n{line}\r\n" in r["headers"]
        if r["warc_type"] == "conversion":
            texts[source["payload"]] = r["block"]
        else:
            assert f"source-payload-digest: {source['payload_digest']}\r\n" in r["block"]
            assert f"conversion: {r['concurrent_to']}\r\n" in r["block"]
    first = PAGES[0][2]
    assert texts[first] == "One <two>\nthreefour\nlink é😀 &nosuch; &lt;"
    meta = next(r["block"] for r in rows if r["warc_type"] == "metadata" and sources[r["refers_to"]]["payload"] == first)
    assert meta.startswith("title: T & U\r\n") and "outlink: /q?a=1&b=2\r\n" in meta
    assert texts["plain & simple < 3"] == "plain & simple < 3" and texts["<p>cut <a href='u"] == "cut"
    assert texts[""] == "" and texts["<!-- never closed <p>x"] == ""
    assert texts[PAGES[6][2]] == " ".join(LONG.split())
    assert warc.derivatives(warc.responses(empty(pages))).count() == 0


def test_warc_text_against_a_parser(spark):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.skip, self.words = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.words += data.split()

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["t"] for r in warc.with_plain_text(pages.select("page_id", "html"), "html", "t").collect()}
    for r in pages.where("html like '%</html>'").collect():
        parser = Words()
        parser.feed(r["html"])
        parser.close()
        assert "".join(got[r["page_id"]].split()) == "".join(parser.words), r["page_id"]


LINKS = [
    "<a href=/x>", "<a href=\"/o'reilly\">", "<a title=\"a>b\" href=\"/z\">", "<A\nHREF = '/q?a=1&amp;b=2'>", "<a data-href=/no href=/yes>",
    "<a title='href=\"/no\"' href=/yes>", "<abbr href=/no>", "<a hrefs=/no>", "<a class=\"x\"href=\"/near\">", "<a disabled href=/bare/>",
    "<a href=''>", "<a name=x>", "<a href=/one href=/two>", "<a/href=/slash>", "<link href=/no>", "<a title=it's href=/yes>", "<p title='<a href=/in>'>",
]


def test_links_against_a_parser(spark):
    from html.parser import HTMLParser

    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            first = next((v for k, v in attrs if k == "href"), None)
            if tag == "a" and first is not None:
                self.found.append(first)

    pages = [(i, "http://a/", f"<p>{x}text</a> ") for i, x in enumerate(LINKS[:-1])] + [(99, "http://a/", "".join(LINKS[:-1]))]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = warc.derivatives(warc.responses(df)).where("warc_type = 'metadata'").collect()
    got = {r["page_id"]: [line[9:] for line in r["block"].split("\r\n") if line.startswith("outlink: ")] for r in rows}
    for i, _, html_text in pages:
        parser = Links()
        parser.feed(html_text)
        assert got[i] == parser.found, html_text


def test_entities(spark):
    rng = random.Random(9)
    names = ["&amp;", "&lt;", "&eacute;", "&#8217;", "&#x1F600;", "&", "amp;", "&copy;", "x", "&quot;", ";", "&middot;"]
    texts = ["".join(rng.choices(names, k=8)) for _ in range(200)]
    # Only references with a semicolon are decoded here, so the rest is kept from the library.
    want = [re.sub(warc._ENTITY, lambda m: html.unescape(m[0]), t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", warc.unescaped(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(texts))] == want


# --- embeddings --------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label, size in ((1, 500), (2, 90), (None, 20)):
        x = rng.normal(size=(size, 24))
        for base in range(0, size - 12, 40):
            x[base + 1 : base + 9] = x[base] + rng.normal(size=(8, 24)) * rng.choice([0.05, 0.2, 0.3])
        if label == 1:
            x[300:420] = x[300] + rng.normal(size=(120, 24)) * 0.1
            x[430:440] = x[430]
        for v in x:
            rows.append((n, [float(a) for a in v], label))
            n += 1
    odd_vectors = [None, [], [0.0] * 24, [1.0] * 23 + [None], [1.0] * 23 + [float("nan")], [1.0] * 23 + [float("inf")], [1.0, 2.0], [1.0, 2.0]]
    for v in odd_vectors:
        rows.append((n, v, 1))
        n += 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("n_links", F.lit("mine"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df.repartition(4)).collect()}
    assert len(got) == n
    ok = {i: np.array(v) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label_of = {i: label for i, _, label in rows}
    links = {
        i: {
            j for j in ok
            if i != j and label_of[i] == label_of[j] and len(ok[i]) == len(ok[j])
            and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93
        }
        for i in ok
    }
    want = sum(map(len, links.values()))
    have = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= len(links.get(i, ())) for i in got)
    assert 0.99 * want <= have <= want
    if have == want:
        for i in got:
            seen, todo = {i}, [i]
            while todo:
                new = links.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))
    assert embeddings.near_duplicates(empty(df)).count() == 0


def roots_of(links):
    """The first row of each row's component in a symmetric matrix of links."""
    root = np.full(len(links), -1)
    for first in range(len(links)):
        front = np.array([first]) if root[first] < 0 else ()
        while len(front):
            root[front] = first
            front = np.flatnonzero(links[front].any(0) & (root < 0))
    return root


def check_embeddings(spark, x, labels, **options):
    """near_duplicates on vectors numbered in order, against all pairs; gives the number of components."""
    rows = [(i, [float(a) for a in v], label) for i, (v, label) in enumerate(zip(x, labels, strict=True))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, **options).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.array(labels)
    links = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    root = roots_of(links)
    assert [got[i]["n_links"] for i in range(len(x))] == links.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == root.tolist()
    return len(set(root.tolist()))


def test_embeddings_bridge(spark):
    """Two groups of one label, tighter than the links between them."""
    rng = np.random.default_rng(5)
    ends = np.zeros((2, 32))
    ends[0, 0], ends[1, :2] = 1, (0.95, (1 - 0.95**2) ** 0.5)
    x = np.repeat(ends, 30, axis=0) + rng.normal(size=(60, 32)) * 0.004
    assert check_embeddings(spark, x, [1] * 60) == 1
    assert check_embeddings(spark, x, [1] * 60, block=16) == 1


def test_embeddings_rare_pairs_beside_a_dense_group(spark):
    """Links of a dense group do not stand in for lost pairs."""
    rng = np.random.default_rng(6)
    dense = np.eye(1, 48)[0] + rng.normal(size=(500, 48)) * 0.005
    ends = rng.normal(size=(400, 48))
    pairs = ends + rng.normal(size=ends.shape) * 0.37
    x = np.concatenate([dense, ends, pairs])
    assert check_embeddings(spark, x, [1] * len(x), block=128) > 401


def test_embeddings_shared_direction(spark):
    """Pairs among vectors that share a direction, of which planes through the origin tell little."""
    rng = np.random.default_rng(7)
    ends = rng.normal(size=(1000, 48)) * 0.08 + 0.09
    x = np.concatenate([ends, ends + rng.normal(size=ends.shape) * 0.043])
    assert check_embeddings(spark, x, [1] * len(x), block=256) > 1000


def test_embeddings_search_without_the_audit_of_all(spark):
    """Samples far smaller than the label: what the descent itself finds, and far fewer comparisons than all pairs."""
    rng = np.random.default_rng(11)
    ends = rng.normal(size=(900, 32))
    x = np.concatenate([ends, ends[:300] + rng.normal(size=(300, 32)) * 0.2, ends[:100] + rng.normal(size=(100, 32)) * 0.3])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.triu(u @ u.T >= 0.93, 1)
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    report = []
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=64, sample=40, report=report).collect()}
    found, want = sum(r["n_links"] for r in got.values()) / 2, links.sum()
    assert 0.98 * want <= found <= want
    assert report and all(len(shares) == 3 for shares in report) and min(report[-1]) >= embeddings.AUDIT


def test_embedding_balls_link_throughout(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([np.eye(1, 24)[0] + rng.normal(size=(700, 24)) * 0.015, rng.normal(size=(100, 24))])
    rows = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<double>, label int").withColumn("width", F.lit(24))
    nodes = embeddings.saved(embeddings.classes_of(df))
    members = embeddings.balls(nodes, 0.93, 64).join(nodes.select("id", "class"), "id").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = {}
    for r in members:
        groups.setdefault(r["leader"], []).append(r["class"])
    assert sum(map(len, groups.values())) == 800 and len(groups) < 130
    for own in groups.values():
        assert (u[own] @ u[own].T).min() >= 0.93


def test_embeddings_repeated_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
