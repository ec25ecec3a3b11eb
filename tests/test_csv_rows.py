"""CSV files read by several tasks, against Spark's own reader of whole files."""

import random

import pytest

from clozemill.sources import readers
from clozemill.sources.csv_rows import _ENDS_INSIDE, read_rows

COLUMNS = ["id", "a b", "text"]


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def cell(rng):
    plain = "".join(rng.choice("abё ") for _ in range(rng.randint(0, 6)))
    kind = rng.random()
    if kind < 0.4:
        return plain
    if kind < 0.5:
        return "x" + plain + '"' + plain  # a quote inside a plain cell is only a sign
    inner = "".join(rng.choice(['""', ",", "\n", "ж", "z", "\n\n", " "]) for _ in range(rng.randint(0, 12)))
    return f'"{inner}"'


def sheet(rng, rows, end="\n"):
    header = 'id,a b,"te\nxt"' if rng.random() < 0.3 else "id,a b,text"
    body = [",".join([str(i), cell(rng), cell(rng)]) + ("\n" if rng.random() < 0.1 else "") for i in range(rows)]
    return "\n".join([header, *body]).replace("\n", end) + (end if rng.random() < 0.5 else "")


def whole(spark, path):
    options = dict(header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")
    return [tuple(r) for r in spark.read.options(**options).csv(path).coalesce(1).collect()]


def numbered(df):
    rows = sorted(df.collect(), key=lambda r: r["row_idx"])
    assert [r["row_idx"] for r in rows] == list(range(len(rows)))
    return [tuple(r)[:-1] for r in rows]


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_reader_of_whole_files(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    path = tmp_path / "d.csv"
    mark = "﻿" if seed % 2 else ""
    path.write_text(mark + sheet(rng, 60, "\r\n" if seed == 4 else "\n"), encoding="utf8", newline="")
    df = read_rows(spark, [str(path)])
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    assert numbered(df) == whole(spark, str(path))


def test_a_cell_over_many_splits(spark, tmp_path, small_splits):
    path = tmp_path / "d.csv"
    long = "\n".join(["строка, и ещё", '""', ""] * 200)
    path.write_text(f'id,a b,text\n1,x,"{long}"\n2,y,z\n3,"",\n', encoding="utf8")
    found = numbered(read_rows(spark, [str(path)]))
    assert found == whole(spark, str(path))
    assert found[0][2] == long.replace('""', '"') and found[1:] == [("2", "y", "z"), ("3", None, None)]


def test_several_files_and_empty_ones(spark, tmp_path, small_splits):
    rng = random.Random(9)
    texts = {"b": sheet(rng, 20), "a": sheet(rng, 15), "none": "id,a b,text\n", "void": "", "c": sheet(rng, 5)}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf8")
    paths = [str(tmp_path / f"{name}.csv") for name in texts]
    found = numbered(read_rows(spark, paths, "id string, a string, t string"))
    assert found == [r for p in paths[:3] + paths[4:] for r in whole(spark, p)]
    (tmp_path / "folder").mkdir()
    for name in ("b", "a"):
        (tmp_path / "folder" / f"{name}.csv").write_text(texts[name], encoding="utf8")
    found = numbered(read_rows(spark, [str(tmp_path / "folder")]))
    assert found == whole(spark, str(tmp_path / "a.csv")) + whole(spark, str(tmp_path / "b.csv"))
    assert numbered(read_rows(spark, [str(tmp_path / "none.csv")])) == []


def test_types_and_broken_rows(spark, tmp_path, small_splits):
    path = tmp_path / "d.csv"
    path.write_text("id,n\nx,1\ny,2\n")
    assert numbered(readers.read_csv_corpus(spark, str(path), schema="id string, n int")) == [("x", 1), ("y", 2)]
    for bad in ("id,n\nx,1,2\n", "id,n\nx\n"):
        path.write_text(bad)
        with pytest.raises(Exception):
            readers.read_csv_corpus(spark, str(path)).collect()


def test_only_broken_rows_are_grouped(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('id,n\nx,1\ny,"2\n3"\n')
    plan = read_rows(spark, [str(path)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "OR" in plan.upper()


@pytest.mark.parametrize("line, inside", [
    ("", False), ("a,b", False), ('a,"b', True), ('a,"b"', False), ('"a""', True), ('"a"""', False),
    ('x"y,z', False), ('"a"b"c,d', False), ('"a"b,"c', True), ('"', True), ('""', False), (' "a', False),
    ("," * 50_000 + '"', True), ('"' + '""' * 50_000, True),
])
def test_lines_that_leave_a_cell_open(line, inside):
    assert bool(_ENDS_INSIDE.fullmatch(line)) is inside
