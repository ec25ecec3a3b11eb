import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clozemill.functions import formats, text


def column(spark, values, build, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_whitespace_is_what_python_splits_on(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    values = [f"{s}a{s}{s}b {s}c{s}" for s in spaces] + ["", " ", "a​b", "x  y"]
    assert column(spark, values, text.collapse_whitespace) == [" ".join(v.split()) for v in values]
    assert column(spark, values, text.strip_whitespace) == [v.strip() for v in values]


def misread(value: str) -> str:
    out = []
    for byte in value.encode():
        char = bytes([byte]).decode("cp1251", errors="ignore")
        out.append(char or chr(byte))
    return "".join(out)


def test_mojibake_is_repaired_and_the_rest_is_left_alone(spark):
    good = ["Привет", "Синапс работает", "Ёж и Йод", "Русский «текст» — №5"]
    unchanged = ["abc", "café", "Суд №5", "Русь", "РЎСѓРґ №5 П", "РћРћРќ 日本", "С" + "é", ""]
    assert column(spark, [misread(v) for v in good], text.repair_mojibake) == good
    assert column(spark, good + unchanged, text.repair_mojibake) == good + unchanged


def test_falsy_values_are_empty(spark):
    def of(dtype, spark_type, values):
        return column(spark, values, lambda c: text.falsy_to_empty(c, spark_type), dtype)

    assert of("int", T.IntegerType(), [0, 7, None]) == ["", "7", ""]
    assert of("boolean", T.BooleanType(), [True, False, None]) == ["True", "", ""]
    assert of("string", T.StringType(), ["0", "", None]) == ["0", "", ""]


def test_metric_format_rounds_the_binary_value(spark):
    values = [0.0, 1.0, 0.00005, 0.00015, 0.03125, 2.00015, 12.34565, -1.23455, 99.99995, 1e9 + 0.33335,
              -0.00001, 5e11 + 0.5, float("inf"), 0.12345, 1 / 3]
    assert column(spark, values, formats.format_metric, "double") == [f"{v:.4f}" for v in values]
    assert column(spark, [None, 1.5], formats.format_metric, "double") == [None, "1.5000"]


def test_seconds_as_text(spark):
    assert column(spark, [0.0, 59.9, 3661.0, 360000.5], formats.format_hms, "double") == [
        "00:00:00", "00:00:59", "01:01:01", "100:00:00",
    ]


def test_fractional_numbers_read_as_in_python(spark):
    rng = random.Random(12)
    # Digits are the JVM's: before JDK 19 a few doubles, like 2e23, show more than they need.
    values = [0.0, 1e7, 123456789.0, 1.5e-5, 0.001, 0.0001, 0.00012345, 1e15, 1e16, 1.25e21, 9999999.5, -3e7, -0.00025, float("inf"), float("nan"), 1e-300]
    values += [float(f"{rng.random() * 10 ** rng.randint(-7, 17):.6g}") for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {r.i: r.t for r in df.select("i", text.falsy_to_empty(F.col("v"), T.DoubleType()).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [str(v or "") for v in values]


def test_number_rendering_stays_small_enough_to_be_compiled(spark):
    # The JVM only ever interprets a method of more than 8000 bytes.
    rows = spark.range(3).select(F.col("id").cast("double").alias("v"))
    shown = rows.select(*[text.falsy_to_empty(F.col("v") * k, T.DoubleType()).alias(f"c{k}") for k in (1, 2, 3)])
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    code = getattr(debug, "MODULE$").codegenString(shown._jdf.queryExecution().executedPlan())
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
