import pytest
from pyspark.sql import functions as F

from quire.functions import headings as H
from quire.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("out")).first()["out"]


def test_normalize(spark):
    assert one(spark, T.normalize_text("t"), t="The Cats, 2 dogs & éclairs is ON mats") == "cats dogs clairs mats"
    assert one(spark, T.normalize_text("t"), t="") == ""


def test_similarity_edges(spark):
    assert one(spark, T.jaccard("a", "b"), a="", b="") == 0.0
    assert one(spark, T.jaccard("a", "b"), a="x y", b="y z") == pytest.approx(1 / 3)
    assert one(spark, T.length_ratio(F.length("a"), F.length("b")), a="", b="abc") == 0.0
    assert one(spark, T.cosine("u", "v"), u=[0.0, 0.0], v=[1.0, 0.0]) == 0.0


def test_cuts(spark):
    assert one(spark, T.truncate_sentences("t", 12), t="One two. Three four. Five") == "One two."
    assert one(spark, T.truncate_sentences("t", 4), t="abcdefgh") == "abcd..."
    assert one(spark, T.truncate_sentences("t", 400), t="short") == "short"
    assert one(spark, T.key_sentences("t", 2), t="aa. bbbb. cc") == " bbbb.  cc."
    assert one(spark, T.dedupe_sentences("t"), t="A long sentence. Tiny. a LONG sentence! Another one here?") == "A long sentence. Another one here."
    assert one(spark, T.truncate_ellipsis("t", 3), t="abcd") == "abc..."


@pytest.mark.parametrize("text", ["Hello World", "HELLO", "Hello world", "hello", "1. Intro", "Éte Été", "They're", "A1b", "", "123", "It'S"])
def test_case_tests_agree_with_python(spark, text):
    assert one(spark, T.is_title("t"), t=text) == text.istitle()
    assert one(spark, T.is_upper("t"), t=text) == text.isupper()


@pytest.mark.parametrize(
    "text, kind, pattern, depth",
    [
        ("1.2.3 Deep", "decimal", "1.2.3", 3), ("4. Four", "decimal", "4", 1), ("7 Seven", "decimal", "7", 1),
        ("IV. Part", "roman", "IV", 1), ("B. Part", "letter", "B", 2), ("b. part", "letter", "b", 3),
        ("2.a part", "mixed", "2.a", 3), ("(3) part", "parenthetical", "(3)", 3), ("(c) part", "parenthetical", "(c)", 4),
    ],
)
def test_numbering(spark, text, kind, pattern, depth):
    n = one(spark, H.numbering("t"), t=text)
    assert (n["type"], n["pattern"], n["depth"]) == (kind, pattern, depth)
    assert one(spark, H.is_numbered("t"), t=text)


def test_not_numbered(spark):
    assert one(spark, H.numbering("t"), t="Plain text") is None


@pytest.mark.parametrize(
    "answer, summary",
    [
        ('{"summary": "s"}', "s"),
        ('```json\n{"summary": "s"}\n```', "s"),
        ('Sure: {"summary": "s"} done', "s"),
        ('{"summary": "s', "Analysis of selected text: sel..."),
        ("", "Analysis of selected text: sel..."),
    ],
)
def test_model_json(spark, answer, summary):
    assert one(spark, T.parse_model_json("a", "s"), a=answer, s="sel")["summary"] == summary


def test_batch_answers(spark):
    assert one(spark, T.batch_answers("a", 2), a='["x","y","z"]') == ["x", "y"]
    assert one(spark, T.batch_answers("a", 2), a='["x"]') == ['["x"]', '["x"]']


def test_small_ones(spark):
    assert one(spark, T.collapse_repeats("t"), t="RRRReport a a a b") == "Report a b"
    assert one(spark, T.spoken_duration("t"), t="w " * 110) == "1:06"
    assert one(spark, T.clean_title("t"), t="  -- A  title**") == "A title"
    assert one(spark, T.strip_fillers("t"), t="please explain this based on the following") == "explain this from:"
