"""Text functions against plain Python on edge strings."""

import re

from pyspark.sql import functions as F

from corvid.functions import text as T

SPACES = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first().y


def test_fold_removes_what_python_calls_space(spark):
    assert len(SPACES) == 29
    text = "a" + "".join(f"{c}b" for c in SPACES) + "​c"
    assert one(spark, text, T.fold("x")) == "".join(text.split())
    assert one(spark, f"{''.join(SPACES)}공 유{''.join(SPACES)}", T.strip("x")) == "공 유"


def test_lengths_are_code_points(spark):
    assert one(spark, "😀a", F.length("x")) == 2


def roman(s):
    v = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}.get(c, 0) for c in s]
    return sum(-a if k + 1 < len(v) and v[k + 1] > a else a for k, a in enumerate(v))


def test_roman(spark):
    for s in ("XIV", "XLIX", "", "MX", "IIX"):
        assert one(spark, s, T.roman_to_int("x")) == roman(s)


def test_join_fragments(spark):
    for parts, want in ((["공", "유"], "공유"), (["2025", "년"], "2025년"), (["으로", "2025년"], "으로 2025년"), (["a", "b"], "a b"), (["협력", "(MOU)"], "협력(MOU)"), ([" ", "x "], "x")):
        assert one(spark, "|".join(parts), T.join_fragments(F.split("x", r"\|"))) == want


def test_truncation_keeps_both_ends(spark):
    text = "\n".join(f"line {k}" for k in range(500))
    got = one(spark, text, T.truncate_middle("x", 400))
    assert got.startswith("line 0\n") and got.endswith("line 499") and re.search(r"\[\.\.\. 중략: 전체 4,389자 중 [\d,]+자 생략 \.\.\.\]", got)
    assert one(spark, "short", T.truncate_middle("x", 400)) == "short"


def test_summaries_are_tidied(spark):
    assert one(spark, " - **요약:** \"한 문장이다.\" ", T.tidy_summary("x")) == "한 문장이다."
    assert one(spark, "가" * 500, T.tidy_summary("x")) is None and one(spark, "  ", T.tidy_summary("x")) is None
    assert one(spark, "가" * 200 + "다. " + "나" * 300, T.tidy_summary("x")) == "가" * 200 + "다."


def test_overlaps_count(spark):
    assert one(spark, "ananana", T.overlapping_count(F.col("x"), "ana")) == 3
    assert one(spark, "a.b\\E a.b", T.overlapping_count(F.col("x"), "a.b")) == 2


def test_keywords(spark):
    assert one(spark, "가, 나·다 ,라.", T.split_keywords("x")) == ["가", "나·다", "라"]
    assert one(spark, "가·나", T.split_keywords("x")) == ["가", "나"]
    assert one(spark, "", T.split_keywords("x")) == []
