"""Hand-worked scores, and the sequence helpers against brute force."""

import math
import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from clozemill.functions import overlap, tokens
from clozemill.operators import metrics, vectors


def scores(spark, rows, **options):
    pairs = spark.createDataFrame(rows, "prediction string, reference string")
    return metrics.compute_text_metrics(pairs, **options).head()


def test_bleu_goldens(spark):
    same = scores(spark, [("the cat sat on the mat", "the cat sat on the mat")])
    assert same.sacrebleu == pytest.approx(100.0)
    assert scores(spark, [("a b c d", "e f g h")]).sacrebleu == 0.0
    assert scores(spark, [("a b c", "a b c")]).sacrebleu == 0.0  # no 4-grams at all
    # 5/6, 3/5, 1/4 and a zero order of 3 four-grams, smoothed to 1/(2*3)
    r = scores(spark, [("the cat sat on a mat", "the cat sat in a mat")])
    precisions = [5 / 6, 3 / 5, 1 / 4, 1 / 6]
    assert r.sacrebleu == pytest.approx(100 * math.exp(sum(map(math.log, precisions)) / 4))
    # brevity: 4 tokens against 6
    r = scores(spark, [("the cat sat on", "the cat sat on the mat")])
    assert r.sacrebleu == pytest.approx(100 * math.exp(1 - 6 / 4))


def test_bleu_sums_counts_over_the_corpus(spark):
    rows = [("a b c d e", "a b c d e"), ("x y z w", "q r s t")]
    precisions = [5 / 9, 4 / 7, 3 / 5, 2 / 3]
    expected = 100 * math.exp(sum(map(math.log, precisions)) / 4)
    assert scores(spark, rows).sacrebleu == pytest.approx(expected)


def test_empty_corpus_scores_zero(spark):
    r = scores(spark, [])
    assert (r.num_examples, r.sacrebleu, r.rouge1, r.meteor) == (0, 0.0, 0.0, 0.0)


def test_13a_tokens(spark):
    cases = {
        "Hello, world!": "Hello , world !",
        "3.5 is 1,000 - or 10-20.": "3.5 is 1,000 - or 10 - 20 .",
        "a&amp;b &lt;c&gt; x-\ny\nz": "a & b < c > xy z",
        "don't [x] «да»": "don't [ x ] «да»",
        "": "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = df.select("t", tokens.tokens_13a(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == cases


def test_rouge_goldens(spark):
    r = scores(spark, [("a b c b d a b", "b d c a b a")])
    assert r.rougeL == pytest.approx(8 / 13)
    assert r.rouge1 == pytest.approx(12 / 13)
    r = scores(spark, [("кит плыл", "кит плыл")])
    assert (r.rouge1, r.rougeL) == (0.0, 0.0)
    r = scores(spark, [("кит плыл", "кит плыл")], tokenizer="unicode")
    assert (r.rouge1, r.rouge2, r.rougeL, r.rougeLsum) == (1.0, 1.0, 1.0, 1.0)


def test_rouge_lsum_unites_lines(spark):
    # line-wise: w1..w5 against "w1 w2 w6" and "w1 w3 w5" covers w1 w2 w3 w5
    r = scores(spark, [("w1 w2 w6\nw1 w3 w5", "w1 w2 w3 w4 w5")])
    assert r.rougeLsum == pytest.approx(2 * 4 / (6 + 5))


def test_meteor_goldens(spark):
    n = 5
    r = scores(spark, [("a b c d e", "a b c d e")])
    assert r.meteor == pytest.approx(1 - 0.5 * (1 / n) ** 3)
    # 4 matches in 2 chunks, P = 4/4, R = 4/5
    r = scores(spark, [("a b d e", "a b c d e")])
    mean = 0.8 / (0.9 + 0.1 * 0.8)
    assert r.meteor == pytest.approx((1 - 0.5 * (2 / 4) ** 3) * mean)
    r = scores(spark, [("big dog", "large dog")], synonyms=spark.createDataFrame([("big", "large"), ("big", "huge"), ("x", "y")], "word string, synonym string"))
    assert r.meteor == pytest.approx(1 - 0.5 * (1 / 2) ** 3)


def table_lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_sequence_helpers_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.choices("abcde", k=rng.randint(0, 12))
        y = rng.choices("abcde", k=rng.randint(0, 12))
        assert overlap._lcs_length(x, y) == table_lcs(x, y)


def traced(x, y):
    """Positions in x on the way back through the whole table: a match first, then left if that keeps more."""
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1][j + 1] = t[i][j] + 1 if a == b else max(t[i][j + 1], t[i + 1][j])
    used, i, j = set(), len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            used.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return used


@pytest.mark.parametrize("held", [1, 3, 64])
def test_positions_are_those_of_the_whole_table(monkeypatch, held):
    monkeypatch.setattr(overlap, "_HELD", held)
    rng = random.Random(4)
    for _ in range(400):
        x, y = (rng.choices("abcdefg", k=rng.randint(0, 25)) for _ in range(2))
        assert overlap._lcs_positions(x, overlap._Line(y)) == traced(x, y)


def plain_union_hits(prediction, reference):
    from collections import Counter

    lines, targets = ([line.split(" ") if line else [] for line in t.split("\n")] for t in (prediction, reference))
    left = Counter(t for x in lines for t in x) & Counter(t for x in targets for t in x)
    hits = 0
    for target in targets:
        for i in sorted(set().union(*[traced(target, line) for line in lines])):
            if left[target[i]]:
                left[target[i]] -= 1
                hits += 1
    return hits


def test_union_over_lines_against_plain_python():
    rng = random.Random(8)
    for _ in range(150):
        a, b = ("\n".join(" ".join(rng.choices("abcdef", k=rng.randint(0, 6))) for _ in range(rng.randint(2, 6))) for _ in range(2))
        assert overlap._union_lcs_hits(a, b) == plain_union_hits(a, b)


def test_tracing_holds_few_rows():
    import tracemalloc

    rng = random.Random(9)
    x, y = rng.choices("abcdefghij", k=6000), rng.choices("abcdefghij", k=6000)
    tracemalloc.start()
    used = overlap._lcs_positions(x, overlap._Line(y))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(used) == overlap._lcs_length(x, y)
    assert peak < 2_500_000  # all rows would take 6000 * 800 bytes


def test_many_lines_that_share_little():
    lines = [f"w{i} v{i % 500} u{i} t{i}" for i in range(1000)]
    assert overlap._union_lcs_hits("\n".join(lines), "\n".join(reversed(lines))) == 4000


def test_lines_are_compared_only_while_hits_are_left(monkeypatch):
    calls = []
    trace = overlap._lcs_positions
    monkeypatch.setattr(overlap, "_lcs_positions", lambda x, line: calls.append(1) or trace(x, line))
    rng = random.Random(10)
    lines = [" ".join(rng.choices([f"w{i}" for i in range(50)], k=30)) for _ in range(60)]
    kept = "\n".join(line for i, line in enumerate(lines) if i % 3 != 1)
    assert overlap._union_lcs_hits(kept, "\n".join(lines)) == 40 * 30
    assert not calls
    changed = kept.replace("w7", "v7")
    assert overlap._union_lcs_hits(changed, "\n".join(lines)) == plain_union_hits(changed, "\n".join(lines))
    assert len(calls) < 60 * 40 / 2


def test_long_texts_are_scored_whole(spark):
    rng = random.Random(5)
    x, y = rng.choices("abcdefgh", k=3000), rng.choices("abcdefgh", k=2500)
    r = scores(spark, [(" ".join(x), " ".join(y))], metrics=("rougeL",))
    assert r.rougeL == pytest.approx(2 * table_lcs(x, y) / 5500)


def test_groups_and_pairing(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "row_idx long, prediction string")
    r = spark.createDataFrame([(1, "a"), (2, "c")], "row_idx long, reference string")
    pairs = metrics.align_pairs(p, r)
    by_row = metrics.rouge_n(pairs, ("row_idx",)).orderBy("row_idx").collect()
    assert [x.rouge1 for x in by_row] == [1.0, 0.0]
    with pytest.raises(Exception, match="but not both"):
        metrics.align_pairs(p, r.where("row_idx = 1")).count()


def test_a_failing_family_leaves_the_others(spark, monkeypatch):
    pairs = spark.createDataFrame([("a b c d", "a b c d", "g")], "prediction string, reference string, k string")
    whole = metrics.isolated_text_metrics(pairs).head()
    assert whole.rougeL == 1.0 and whole.sacrebleu == pytest.approx(100.0)

    def broken(*_):
        raise RuntimeError("no tokens today")

    monkeypatch.setattr(metrics.tokens, "word_tokens", broken)
    partial = metrics.isolated_text_metrics(pairs, ("k",)).head()
    assert partial.rougeLsum == 1.0
    assert "no tokens today" in partial.meteor_error


def test_the_full_record_has_vectors(spark):
    pairs = spark.createDataFrame([("a b c d", "a b c d")], "prediction string, reference string")
    rows = [(1, side, 0, [1.0, 2.0]) for side in ("prediction", "reference")]
    vecs = spark.createDataFrame(rows, "pair_id int, side string, pos int, vec array<double>")
    whole = metrics.isolated_text_metrics(pairs, token_vectors=vecs).head()
    assert whole.bertscore_f1 == pytest.approx(1.0) and whole.rouge2 == 1.0
    broken = metrics.isolated_text_metrics(pairs, token_vectors=vecs.drop("vec")).head()
    assert "vec" in broken.bertscore_error and broken.meteor > 0.9


def vector_rows(rng, pair, side, n):
    return [(pair, side, i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(n)]


def test_embedding_match(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)  # many block pairs per pair
    rng = random.Random(1)
    rows = vector_rows(rng, 1, "prediction", 9) + vector_rows(rng, 1, "reference", 14)
    same = vector_rows(rng, 2, "prediction", 3)
    rows += same + [(2, "reference", i, v) for _, _, i, v in same]
    rows += vector_rows(rng, 3, "prediction", 2)
    df = spark.createDataFrame(rows, "pair_id int, side string, pos int, vec array<double>")

    def cosine(a, b):
        dot = sum(p * q for p, q in zip(a, b))
        return dot / math.sqrt(sum(p * p for p in a) * sum(q * q for q in b))

    p1 = [r[3] for r in rows if r[:2] == (1, "prediction")]
    r1 = [r[3] for r in rows if r[:2] == (1, "reference")]
    p = sum(max(cosine(a, b) for b in r1) for a in p1) / len(p1)
    r = sum(max(cosine(a, b) for a in p1) for b in r1) / len(r1)
    got = vectors.embedding_match(df, ("pair_id",)).orderBy("pair_id").collect()
    assert got[0].bertscore_f1 == pytest.approx(2 * p * r / (p + r))
    assert got[1].bertscore_f1 == pytest.approx(1.0)
    assert got[2].bertscore_f1 == 0.0


def test_isolation_without_checkpoints_and_with_null_groups(spark, monkeypatch):
    rows = [("a b c d", "a b c d", None), ("a b c d", "a b c x", "g")]
    pairs = spark.createDataFrame(rows, "prediction string, reference string, k string")
    got = {r.k: r for r in metrics.isolated_text_metrics(pairs, ("k",)).collect()}
    assert got[None].rougeL == 1.0 and got[None].meteor > 0.9 and got["g"].rouge1 == 0.75
    text = metrics.isolated_text_metrics(pairs, ("k",))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Scan") == 1 and "Join" not in text

    # What fails inside a pair stays in its family and group.
    @F.pandas_udf("struct<value:int,error:string>")
    def bad(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        none = pd.Series([None] * len(a), dtype="Int32")
        return pd.DataFrame({"value": none, "error": ["no length"] * len(a)})

    monkeypatch.setattr(metrics, "lcs_length", bad)
    got = {r.k: r for r in metrics.isolated_text_metrics(pairs, ("k",)).collect()}
    assert got["g"].rougeL is None and got["g"].rouge1 is None and "no length" in got["g"].rouge_error
    assert got["g"].meteor > 0 and got["g"].sacrebleu > 0 and got["g"].meteor_error is None
    with pytest.raises(Exception, match="no length"):
        metrics.rouge_l(pairs).collect()



def test_common_grams_against_counters():
    rng = random.Random(5)
    for _ in range(300):
        x, y = (rng.choices("abcdé", k=rng.randint(0, 12)) for _ in range(2))
        want = []
        for n in (1, 2, 3, 4):
            a, b = (Counter(zip(*[side[k:] for k in range(n)], strict=False)) for side in (x, y))
            want.append(sum((a & b).values()))
        assert overlap._common_grams(x, y, (1, 2, 3, 4)) == want
        assert overlap._common_grams(x, y, (2,)) == want[1:2]


def test_overlaps_hold_no_batch_of_python_texts():
    """Texts stay Arrow's; a pandas column would hold a batch of them a second time."""
    used = [overlap.lcs_length, overlap.union_lcs_hits]
    assert {f.evalType for f in used} == {PythonEvalType.SQL_SCALAR_ARROW_UDF}
    whole = pa.array(["a b"] * 3)
    got = overlap.lcs_length.func(whole, pa.array(["a", "b c", ""]))
    assert got.to_pylist() == [{"value": n, "error": None} for n in (1, 1, 0)]
