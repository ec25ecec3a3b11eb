import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.operators import batches


def rows(spark, n=11):
    data = [(i * 5, " ".join(["w"] * (i % 7)), "a b c") for i in range(n)]
    return spark.createDataFrame(data, "row_idx long, source string, target string").repartition(3)


def test_truncation(spark):
    out = batches.truncate_tokens(rows(spark), 4, 2).orderBy("row_idx").collect()
    assert [len(r.input_ids) for r in out] == [min(i % 7, 4) for i in range(11)]
    assert all(len(r.input_ids) == len(r.attention_mask) and r.labels == ["a", "b"] for r in out)
    assert all(r.truncated for r in out)


def test_pluggable_tokenizer(spark):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [len(w) for w in t.split()])

    out = batches.truncate_tokens(rows(spark), 3, 3, lengths).orderBy("row_idx").collect()
    assert out[3].input_ids == [1, 1, 1] and out[3].labels == [1, 1, 1] and not out[3].truncated


def test_batches_in_order_and_shuffled(spark):
    df = rows(spark)
    out = batches.assign_batches(df, 4).orderBy("row_idx").collect()
    assert [(r.batch_id, r.batch_pos) for r in out] == [(i // 4, i % 4) for i in range(11)]

    def order(seed):
        shuffled = batches.assign_batches(df, 4, seed=seed).collect()
        places = {(r.batch_id, r.batch_pos): r.row_idx for r in shuffled}
        assert sorted(places) == [(i // 4, i % 4) for i in range(11)]
        return [places[k] for k in sorted(places)]

    assert order(1) == order(1) != order(2)
    assert sorted(order(1)) == [i * 5 for i in range(11)]


def test_padding_per_batch(spark):
    tokens = batches.truncate_tokens(rows(spark), 5, 2, lambda c: F.transform(batches.words(c), F.length))
    padded = batches.pad_batches(batches.assign_batches(tokens, 4), F.lit(0)).collect()
    for batch in {r.batch_id for r in padded}:
        members = [r for r in padded if r.batch_id == batch]
        longest = max(sum(r.attention_mask) for r in members)
        assert {len(r.input_ids) for r in members} == {longest}
        for r in members:
            assert r.attention_mask == [1] * sum(r.attention_mask) + [0] * (longest - sum(r.attention_mask))
            assert r.labels == [1, 1]
