from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.functions import text as tx
from docengine.operators import chunking, cleaning, understanding


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_clean_text_order(spark):
    raw = "Co ver​\r\nhos-\npital  stay\n12\nsame\nsame\n\n\n\n\nend — “q”\r"
    assert one(spark, raw, tx.clean_text) == 'Co ver\nhospital stay\nsame\n\nend - "q"'
    assert one(spark, None, tx.clean_text) is None
    assert one(spark, "", tx.clean_text) == ""
    assert one(spark, "é-\né", tx.clean_text) == "éé"
    assert one(spark, "a\rb", tx.clean_text) == "ab"  # a lone carriage return is a control character


def test_nfkc(spark):
    assert one(spark, "ﬁne", lambda c: tx.nfkc(c)) == "fine"
    assert one(spark, None, lambda c: tx.nfkc(c)) is None


def test_tokens_and_sentences(spark):
    assert one(spark, " A b  a ", tx.blank_tokens) == ["a", "b", "a"]
    assert one(spark, "", tx.blank_tokens) == []
    assert one(spark, None, tx.word_tokens) == []
    assert one(spark, "One. Two! a | b", tx.sentences) == ["One.", "Two!", "a", "b"]
    assert one(spark, "", tx.token_estimate) == 1
    assert one(spark, "It is so. [C_1] It was.", tx.tags) == ["C_1"]
    assert one(spark, "", tx.symbol_ratio) == 1.0
    assert one(spark, None, tx.needs_ocr) is True


def test_jaccard_of_empty(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, "", lambda c: tx.jaccard(empty, F.array(F.lit("a")))) == 0.0


def test_windows(spark):
    pages = spark.createDataFrame([(n, "\n".join(f"line {i}" for i in range(n))) for n in (0, 1, 4, 5)], "page_id int, cleaned_text string")
    got = {(r.page_id, r.start): r.text for r in chunking.line_windows(pages).collect()}
    assert set(got) == {(1, 0), (4, 0), (4, 2), (5, 0), (5, 2), (5, 4)}
    assert got[(5, 4)] == "line 4"


def test_parent_rows_and_types(spark):
    rows = spark.createDataFrame([(1, 1, ["LIMITS", ""]), (1, 2, ["a", "b"]), (2, 1, ["x", "y"])], "page_id int, row_no int, cells array<string>")
    got = {(r.page_id, r.row_no): (r.is_parent, r.parent_row) for r in chunking.with_parent_rows(rows).collect()}
    assert got == {(1, 1): (True, "LIMITS | "), (1, 2): (False, "LIMITS | "), (2, 1): (False, None)}
    assert one(spark, "Claim is not covered", chunking.chunk_type) == "exclusion"
    assert one(spark, "co payment", chunking.chunk_type) == "policy_clause"
    assert one(spark, "About us page", chunking.section) == "About Us"


def test_word_lines_anchor_moves_at_breaks_only(spark):
    ys = [0.0, 5.0, 7.0, 12.0, 14.0]
    words = spark.createDataFrame([(1, y, 0.0, str(i)) for i, y in enumerate(ys)], "page int, y0 double, x0 double, word string")
    lines, anchor = [], None
    for i, y in enumerate(ys):
        if anchor is None or abs(y - anchor) > 6:
            lines.append(str(i))
            anchor = y
        else:
            lines[-1] += f" {i}"
    assert cleaning.word_lines(words, ["page"]).first()["lines"] == lines


def test_query_quirks(spark):
    assert one(spark, "history of claims", understanding.is_small_talk) is True
    assert one(spark, "exclusions", understanding.first_intent) == "general"
    assert one(spark, "network hospital list", understanding.first_intent) == "hospital"
    assert one(spark, " What  is c0ver?? ", understanding.preprocess) == "What is cover?"
    assert one(spark, "please tell me more", understanding.rewrite) == "more"
    assert one(spark, "limits", understanding.rewrite) == "limits policy details"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n-1\r\t", max_size=30), min_size=1, max_size=8))
def test_clean_text_is_stable(spark, texts):
    once = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.clean_text(F.col("t")).alias("t"))
    for r in once.withColumn("again", tx.squeeze_blank_lines(tx.trim_lines(F.col("t")))).collect():
        assert r.again.strip() == r.t.strip() and "\r" not in r.t


def test_runs_of_equal_lines(spark):
    texts = ["a\na\nb", "a\n\n\nb", "", "\n\n", "a\na", "aa\na\na\naa", "x\ny\nx", "a\n\n", "é\né\u2028é\né", " a\na"]
    want = ["\n".join(line for i, line in enumerate(t.split("\n")) if i == 0 or line != t.split("\n")[i - 1]) for t in texts]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.drop_repeated_neighbours(F.col("t")).alias("t")).collect()]
    assert got == want
