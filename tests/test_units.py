"""Hand-worked rows per operator (values worked out from the scoring rules)."""

from decimal import Decimal

from pyspark.sql import functions as F

from gradewell.functions import count_sub, splitlines, strip
from gradewell.operators.metrics import lang_feature_vote, mi_band
from gradewell.plans import comment as COM
from gradewell.plans import efficiency as EFF
from gradewell.plans import standardization as STD
from gradewell.plans.modularity import ca_band, ce_band, lcom2_band


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_strip_and_count(spark):
    assert one(spark, strip, " \t a b \n") == "a b"
    assert one(spark, lambda c: count_sub(c, "aa"), "aaaa a aa") == 3
    assert one(spark, splitlines, "a\nb\n") == ["a", "b"]
    assert one(spark, splitlines, "") == []


def test_indent_breaks(spark):
    code = "a\n  b\n      c\n\n d\n    e"
    # a->b (2): break; b->c (4): ok; c, blank: skip; d->e (3): break
    assert one(spark, STD.indent_breaks, code) == 2


def test_std_score_exact_decimal(spark):
    # python: only rule 1 (0.5) hits -> 9.5 * 3
    code = "def f(x):\n    return x"
    got = spark.createDataFrame([(code, "python")], "c string, l string") \
        .select(STD.std_score(F.col("c"), F.col("l")).alias("s")).first()["s"]
    assert got == 28.5


def test_mi_bands(spark):
    for mi, band in [(85.0, 5.0), (84.9, 4.0), (65.0, 4.0), (50.0, 3.0), (30.0, 2.0), (29.9, 1.0)]:
        assert one(spark, mi_band, mi, "double") == band


def test_modularity_bands(spark):
    for ce, b in [(5, 5), (6, 4), (8, 4), (9, 3), (12, 3), (13, 2), (15, 2), (16, 1)]:
        assert one(spark, ce_band, ce, "int") == b
    for ca, b in [(0, 1), (1, 2), (2, 2), (3, 5), (7, 5), (8, 4), (10, 4), (11, 3), (14, 3), (15, 1)]:
        assert one(spark, ca_band, ca, "int") == b
    for v, b in [(0.2, 5), (0.35, 4), (0.5, 3), (0.7, 2), (0.71, 1)]:
        assert one(spark, lcom2_band, v, "double") == b


def test_ecc_score(spark):
    for ecc, s in [(0.0, 30.0), (0.5, 30.0), (1.75, 20.0), (3.0, 10.0), (4.0, 10.0)]:
        assert one(spark, EFF.ecc_score, ecc, "double") == s


def test_cls(spark):
    for n, v in [(0, 0.0), (2, 0.0), (3, 1 / 28), (30, 1.0), (31, 1.0)]:
        assert abs(one(spark, COM.cls, n, "int") - v) < 1e-12


def test_language_vote(spark):
    assert one(spark, lang_feature_vote, "def f():\n    return None") == "python"
    assert one(spark, lang_feature_vote, "") == "unknown"
    assert one(spark, lang_feature_vote, "x = 1") == "unknown"
    assert one(spark, lang_feature_vote, "#include <x>\nint main() { return 0; }") == "cpp"


def test_comment_islands(spark):
    code = "x = 1\n# a\n# b\ny = 2  # c\n# d"
    df = spark.createDataFrame([(code, "python")], "code string, lang string")
    df = df.select("*", splitlines(F.col("code")).alias("ls"))
    df = df.select("*", F.transform("ls", lambda l: strip(l).startswith("#")).alias("fh"),
                   F.transform("ls", lambda l: strip(l).startswith("//")).alias("fs"))
    cm = df.select(COM.comments_of(F.col("code"), F.col("lang"), F.col("ls"), F.col("fh"), F.col("fs")).alias("c")).first()["c"]
    assert sorted(cm["comments"]) == ["a b", "c", "d"]
    assert cm["n_lines"] == 4
    # a block on line 0 is dropped, a single comment on line 0 counts
    code2 = "# a\n# b\ny"
    df2 = spark.createDataFrame([(code2, "python")], "code string, lang string")
    df2 = df2.select("*", splitlines(F.col("code")).alias("ls"))
    df2 = df2.select("*", F.transform("ls", lambda l: strip(l).startswith("#")).alias("fh"),
                     F.transform("ls", lambda l: strip(l).startswith("//")).alias("fs"))
    cm2 = df2.select(COM.comments_of(F.col("code"), F.col("lang"), F.col("ls"), F.col("fh"), F.col("fs")).alias("c")).first()["c"]
    assert cm2["comments"] == []
