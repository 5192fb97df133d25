import math
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X


def on(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("We compare against e.g. prior work. The score is 3.14 in Fig. 2. This remains stable.", ["We compare against e.g. prior work.", "The score is 3.14 in Fig. 2.", "This remains stable."]),
        ("One! Two? Three.", ["One!", "Two?", "Three."]),
        ('He said "stop." Then left.', ['He said "stop.', '" Then left.']),
        ("It is etc. and more. Done", ["It is etc. and more.", "Done"]),
        ("  spread\n over  lines.\n\nNext ", ["spread over lines.", "Next"]),
        ("", []),
        ("...", ["..."]),
    ],
)
def test_split_sentences(spark, text, parts):
    assert on(spark, text, X.split_sentences) == parts


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        (r"50\% of it % gone", r"50\% of it"),
        ("a % b\nc", "a c"),
        (r"x $$a$$ y $b$ z", "x y z"),
        (r"cost \$5 and \$6 end", r"cost \ 6 end"),
        (r"\footnote{out} in", "in"),
        (r"\footnote{a \emph{b} c} in", "a b c in"),
        (r"\label{k} t", "k t"),
        (r"\section[s]{Long} t", "Long t"),
        (None, None),
    ],
)
def test_clean_tex(spark, text, clean):
    found = on(spark, text, X.clean_tex)
    assert (found and " ".join(found.split())) == clean


def test_long_math_does_not_exhaust_the_stack(spark):
    assert on(spark, "a $" + "x\\, " * 40_000 + "$ b", X.clean_tex) == "a b"
    assert on(spark, "a \\[" + "y\n" * 60_000 + "\\] b", X.clean_tex) == "a b"


def test_title_is_squeezed(spark):
    assert on(spark, "\\section{ A \n\n long\ttitle }", X.mark_sections) == "\n[[SECTION:A long title]]\n"


def test_slug(spark):
    assert [on(spark, s, X.slug) for s in ("A & B", "", "!!", "x_Y")] == ["a_b", "untitled", "untitled", "x_y"]


def test_ngrams_of_short_lists(spark):
    assert on(spark, "one two", lambda c: X.features(X.tokens(c))) == ["one", "two", "one_two"]
    assert on(spark, "", lambda c: X.features(X.tokens(c))) == []
    assert on(spark, "a b c d", lambda c: X.phrases(c, 3, 5, 5)) == []
    assert sorted(on(spark, "a b c d a b c", lambda c: X.phrases(c, 3, 3, 5))) == ["a b c", "b c d", "c d a", "d a b"]


def test_punctuation_entropy(spark):
    assert on(spark, "a, b; c", X.punctuation_entropy) == pytest.approx(1.0)
    assert on(spark, "a, b, c; d", X.punctuation_entropy) == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert on(spark, "none", X.punctuation_entropy) == 0.0


def test_scores_stay_in_bounds(spark):
    random.seed(3)
    pool = ["novel", "framework", "the", "of", "data,", "moreover", "zig", "(x)", "important", "12"]
    texts = [(" ".join(random.choices(pool, k=random.randint(0, 40))),) for _ in range(200)]
    tok = X.tokens(F.col("t"))
    out = spark.createDataFrame(texts, "t string").select(X.thinness(tok).alias("a"), X.low_specificity(tok).alias("b"), X.boilerplate_discount(F.col("t"), tok).alias("c"), X.content_ratio(tok).alias("d")).collect()
    assert all(0 <= v <= 1 for r in out for v in r)
    assert max(r.c for r in out) <= 0.35


def test_line_label(spark):
    row = spark.range(1).select(X.line_label(F.lit(3), F.lit(3)), X.line_label(F.lit(3), F.lit(5), "Context ")).first()
    assert list(row) == ["L3", "Context L3-L5"]


def test_rounding_is_pythons(spark):
    random.seed(5)
    values = [k / 10**d for d in (2, 3, 4, 5) for k in random.sample(range(10**d), 90)] + [k / 2**j for j in range(1, 12) for k in range(0, 2**j, 37)]
    values += [random.random() for _ in range(200)] + [0.0, 1.0, 0.075, 0.005, 0.125, 0.0625, 2.675, 1e-9, 5e-5, -0.125, -0.375, -2.675, 123456.78125]
    values += [math.nextafter(v, up) for v in values for up in (-1, 2)]
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *[X.rounded(x, d).alias(f"r{d}") for d in (2, 3, 4)], X.two_decimals(F.abs("x")).alias("t")).collect()
    assert len(rows) == len(values)
    for r in rows:
        assert [r.r2, r.r3, r.r4, r.t] == [round(r.x, 2), round(r.x, 3), round(r.x, 4), f"{abs(r.x):.2f}"], r.x
    assert on(spark, "x", lambda c: X.rounded(F.when(c == "y", 1.0), 2)) is None
