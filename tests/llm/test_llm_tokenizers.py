"""Byte-level BPE, alignment of two tokenizers and fill-in-middle against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clozemill.llm import align, byte_bpe, fim, pieces

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "word and other words, 12 of them. " * 3000
IDS = "doc_id bigint, text string"


def hostile(n=600, seed=4):
    rng = random.Random(seed)
    letters = [*"ab '\n\t  é.9\x1c\x85s<|aaab", "<|endoftext|>", "<s>", "'re", "　", " ", "▁", " word", "日本", "한국어", "привет", "😀", "՘", "\x00", "<P>"]
    texts = ["", " ", "  a", "a  b\n \n c ", "x<|endoftext|>y <s> </s><unk><0x41>", "é" * 50, "a" * 4000, "ab" * 3000, "日本語  한국어 😀", "▁x y▁", "﻿x", LONG]
    return texts + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*hostile(), None])], IDS)
    return given.union(odd).repartition(7).cache()


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(7, "same text twice over"), (7, "same text twice over"), (8, "same text"), (None, "No id here."), (None, None)]
    return spark.createDataFrame(rows, IDS)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def empty(df):
    return df.where("false")


# --- byte-level BPE ----------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_multi(codec):
    import tiktoken

    return tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_ids_and_bytes_equal_the_library(docs, tiktoken_multi):
    path, pattern = RANKS, public_tokenizers.PATTERN
    rows = byte_bpe.decode(byte_bpe.encode(docs.withColumn("IDS", F.lit("mine")), path, pattern), path).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == tiktoken_multi.encode_ordinary(r["text"] or ""), r["text"]
        assert bytes(r["decoded"]) == (r["text"] or "").encode() == tiktoken_multi.decode_bytes(r["ids"])


def test_every_code_point_is_cut_as_by_the_library(codec, tiktoken_multi):
    rng = random.Random(6)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    for i in range(0, len(points), 2000):
        text = "".join(x + rng.choice(["a", " ", "1", ""]) for x in points[i : i + 2000])
        ids = memoryview(codec.encode(text)).cast("i").tolist()
        assert ids == tiktoken_multi.encode_ordinary(text)


def test_compatible_neighbours_are_those_that_merging_keeps(codec):
    rng = random.Random(8)
    tokens = range(len(codec.token))
    short = [t for t in tokens if codec.size[t] <= 2]
    for _ in range(20_000):
        left, right = (rng.choice(rng.choice((tokens, short))) for _ in range(2))
        assert codec._seam(left, right) == codec._plain(left, right)


def random_ranks(rng):
    """A vocabulary over three letters, made by merging tokens of it, in a shuffled or grown order."""
    tokens = [b"a", b"b", b"c"]
    while len(tokens) < 25:
        new = rng.choice(tokens) + rng.choice(tokens)
        if new not in tokens and len(new) <= 8:
            tokens.append(new)
    if rng.random() < 0.5:
        rng.shuffle(tokens)
    return {t: i for i, t in enumerate(tokens)}


def test_backtracking_is_merging_in_any_vocabulary(tmp_path):
    """Also where a part has a higher rank than the whole, or merging never makes a token."""
    import base64

    rng, seams = random.Random(9), Counter()
    for i in range(60):
        ranks = random_ranks(rng)
        path = tmp_path / f"{i}"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        codec = byte_bpe.Codec(str(path), public_tokenizers.PATTERN)
        seams[codec.ordered] += 1
        for _ in range(60):
            piece = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
            want = [ranks[piece]] if piece in ranks else [ranks[x] for x in byte_bpe.merged(piece, ranks)]
            assert codec.piece(piece) == want
    assert seams[True] and seams[False]


def test_long_pieces_take_linear_time(codec, tiktoken_multi):
    text = "".join(random.Random(2).choices("abcdefgh", k=200_000))
    assert memoryview(codec.encode(text)).cast("i").tolist() == tiktoken_multi.encode_ordinary(text)


def test_a_full_table_starts_anew(codec, tiktoken_multi, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 5)
    for text in hostile(50):
        assert memoryview(codec.encode(text)).cast("i").tolist() == tiktoken_multi.encode_ordinary(text)


def test_bpe_odd_tables(docs, repeated):
    path, pattern = RANKS, public_tokenizers.PATTERN
    assert byte_bpe.decode(byte_bpe.encode(empty(docs), path, pattern), path).count() == 0
    assert byte_bpe.digests(byte_bpe.encode(empty(docs), path, pattern), path).count() == 0
    rows = byte_bpe.decode(byte_bpe.encode(repeated, path, pattern), path).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == sorted(r["text"] or "" for r in repeated.collect())
    nothing = repeated.withColumn("ids", F.lit(None).cast("array<int>"))
    assert all(r["decoded"] == b"" for r in byte_bpe.decode(nothing, path).collect())


def test_bpe_digests(docs, tiktoken_multi):
    rows = byte_bpe.digests(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == docs.count() and "ids" not in rows[0]
    for r in rows:
        ids = tiktoken_multi.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(r["text"] or "")


def test_splitter_paths_agree():
    cut = pieces.Splitter(public_tokenizers.PATTERN)
    for text in hostile(200):
        assert cut.pieces(text) == cut.exact.findall(text)


# --- alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(BPE)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def plain_alignment(texts, libraries):
    """Per text: ids of both, groups and links; and the counts of linked pairs over all texts."""
    one, two = libraries
    letters = {c: b for b, c in align.byte_letters().items()}
    out, count = [], Counter()
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append(([], [], [], []))
            continue
        ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b)] if len(text) < 500 else None
        if ends is None:
            import itertools

            ends = [list(itertools.accumulate(map(len, x))) for x in (bytes_a, bytes_b)]
        at_a, at_b = dict(zip(ends[0], a, strict=True)), dict(zip(ends[1], b, strict=True))
        shared = sorted(at_a.keys() & at_b.keys())
        links = [(at_a[e], at_b[e]) for e in shared]
        groups, i, j = [], 0, 0
        for e in shared:
            p, q = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
            groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            i, j = p, q
        count.update(links)
        out.append((a, b, groups, links))
    return out, count


def check_alignment(rows, texts, libraries):
    want, count = plain_alignment(texts, libraries)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    expected = [
        (len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha(";".join(groups)) if groups else "")
        for a, b, groups, links in want
    ]
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(expected)
    return expected


@pytest.mark.parametrize("size", [align.BLOCK, 2000])
def test_alignment_equals_plain_python(docs, libraries, size):
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = align.align(docs.withColumn("block", F.lit("mine")), BPE, MODEL, keep=("doc_id", "block"), size=size).collect()
    assert rows[0].asDict().keys() == {"doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    expected = dict(zip(given, check_alignment(rows, list(given.values()), libraries), strict=True))
    for r in rows:
        assert tuple(r)[2:] == expected[r["doc_id"]] and r["block"] == "mine"


def test_alignment_of_repeated_rows_and_no_rows(docs, repeated, libraries):
    rows = align.align(repeated, BPE, MODEL).collect()
    check_alignment(rows, [r["text"] or "" for r in repeated.collect()], libraries)
    assert sorted(str(r["doc_id"]) for r in rows) == ["7", "7", "8", "None", "None"]
    assert align.align(empty(docs), BPE, MODEL).count() == 0
    assert align.align(docs.select("doc_id", F.lit("").alias("text")).limit(3), BPE, MODEL).where("n_a = 0 and groups_sha256 = ''").count() == 3


def test_windows_table_starts_anew(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "KNOWN", 40)
    known = align.Windows(align.ByteLevel(BPE), align.PieceModel(MODEL))
    texts = [t for t in hostile(80) if t]
    for text, (a, b, groups, _) in zip(texts, plain_alignment(texts, libraries)[0], strict=True):
        ids = known.encode([text])
        assert [list(x[0]) for x in ids] == [a, b]
        assert ";".join(known.text[w] for w in known.of(*ids)[0]) == ";".join(groups)
        if known.full():
            known.clear()


def test_anchors_cut_most_words_apart(libraries):
    known = align.Windows(align.ByteLevel(BPE), align.PieceModel(MODEL))
    text = "The quick brown fox jumps over the lazy dog near the river bank"
    first, ends = known.of(*known.encode([text, None, text]))
    assert ends.tolist() == [0, 13, 13, 26] and len(known.text) == 12
    assert first[:13].tolist() == first[13:].tolist()


def test_alignment_moves_blocks_and_not_links(docs):
    plan = align.align(docs, BPE, MODEL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


# --- fill in the middle ------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_equals_plain_python(docs):
    forms = Counter()
    wide = docs.withColumn("FORM", F.lit("mine")).withColumn("other", F.lit(3))
    for size in (fim.FRAME, 5):
        rows = fim.transform(fim.framed(wide, size=size))
        back = {r["doc_id"]: r for r in fim.texts(fim.restored(rows), "restored").collect()}
        out = {r["doc_id"]: r["text"] for r in fim.texts(rows.select("doc_id", "output"), "output").collect()}
        for d in docs.collect():
            r = back[d["doc_id"]]
            n, form, prefix, middle, output = plain_fim(*d)
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
            assert out[d["doc_id"]] == output and r["output_sha256"] == sha(output)
            assert r["text"] == (d["text"] or "") and r["restored_sha256"] == sha(d["text"] or "") and r["other"] == 3
            forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 20


def test_only_cut_frames_are_opened(monkeypatch):
    frames = fim.frames_of("".join(random.Random(1).choices("añ日😀", k=1000)), size=10)
    opened = []
    read = fim.text_in
    monkeypatch.setattr(fim, "text_in", lambda f: opened.append(f) or read(f))
    part = fim.between(frames, 105, 777)
    assert len(opened) == 2 and fim.length(part) == 672
    assert [f.first for f in part] == [0, 5, *range(15, 665, 10), 665][: len(part)]
    assert sum(f.data in {g.data for g in frames} for f in part) >= len(part) - 2


@pytest.mark.parametrize("text", ["<", "<P", "<S<", ">P><M", "ab<S", "<<PP>"])
def test_beginnings_of_markers_in_the_text(text):
    """Cuts beside such beginnings must not be taken for markers."""
    for doc_id in range(300):
        for size in (1, 2, 100):
            form, prefix, middle, output = fim.turned(fim.frames_of(text, size), doc_id)
            want = plain_fim(doc_id, text)
            assert (form, prefix, middle) == want[1:4] and fim.digest(output) == sha(want[4])
            assert "".join(map(fim.text_in, fim.rebuilt(output, form))) == text


def test_fim_odd_rows(docs, repeated):
    assert fim.restored(fim.transform(fim.framed(empty(docs)))).count() == 0
    rows = fim.restored(fim.transform(fim.framed(repeated))).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["output_sha256"], r["restored_sha256"]) for r in rows)
    want = Counter((d["doc_id"], *(x := plain_fim(*d))[:2], sha(x[4]), sha(d["text"] or "")) for d in repeated.collect())
    assert got == want
