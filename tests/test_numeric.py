from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailscope.functions.numeric import count_where, money_mean, money_percent, percent, rounded_ratio, safe_divide
from retailscope.functions.texts import excerpt, stripped, word_count
from retailscope.operators.risk import four_digits
from retailscope.sources.csv import number

TWO = Decimal("0.01")


def half_up(num, den, digits=2):
    exact = Decimal(num) / Decimal(den)
    return float(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(10**9), 10**9), st.integers(1, 10**6)), min_size=5, max_size=50))
def test_rounded_ratio_is_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = [r[0] for r in df.select(rounded_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [half_up(n, d) for n, d in pairs]


def test_ties_go_away_from_zero_and_zero_divides_to_null(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (1005, 100000), (0, 7), (5, 0)], "n bigint, d bigint")
    got = [r[0] for r in df.select(rounded_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [0.13, -0.13, 0.01, 0.0, None]
    assert str(got[3]) == "0.0"


def test_money_helpers(spark):
    df = spark.sql("SELECT cast(10.05 as decimal(12,2)) AS a, cast(-3.35 as decimal(12,2)) AS b, 2L AS n")
    row = df.select(money_mean(F.col("a"), F.col("n")), money_percent(F.col("b"), F.col("a")), percent(F.lit(1), F.lit(3))).first()
    assert tuple(row) == (5.03, -33.33, 33.33)


def test_conditional_count_of_nothing_is_zero(spark):
    df = spark.sql("SELECT cast(null as string) AS x WHERE false")
    assert df.agg(count_where(F.col("x") == "a")).first()[0] == 0


def test_safe_divide(spark):
    df = spark.sql("SELECT 1 AS a, 0 AS z, cast(null as int) AS m")
    assert tuple(df.select(safe_divide(F.col("a"), F.col("z")), safe_divide(F.col("a"), F.col("m"))).first()) == (None, None)


def test_four_digits_like_percent_g(spark):
    values = [0.0, 1.0, 0.12344, 0.1, 12.5, 1234.4, 9999.6, 12345.0, 0.00012341, 0.00001234, 3.67, 250.0, 1e10, -0.5, 99999.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(four_digits(F.col("v"))).collect()] == [f"{v:.4g}" for v in values]


def test_published_number_texts(spark):
    df = spark.createDataFrame([("$177,134,263.74",), ("6.85%",), ("138116",)], "t string")
    assert [r[0] for r in df.select(number(F.col("t"))).collect()] == [177134263.74, 6.85, 138116.0]


def test_words_excerpts_and_space(spark):
    texts = ["", "  one\ttwo three four\n", "x" * 199 + " y", "z" * 201]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(word_count(F.col("t")), stripped(F.col("t")), excerpt(F.col("t"))).collect()
    for text, (words, bare, cut) in zip(texts, got, strict=True):
        assert words == len(text.split())
        assert bare == text.strip()
        assert cut == text[:200].rstrip() + ("…" if len(text) > 200 else "")
