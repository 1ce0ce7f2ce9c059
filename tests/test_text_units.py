"""Unit rows with hand-computed answers for the text traps."""

import random

import pytest
import regex
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.sources import files


def _one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_clean_text_rules_and_no_trim(spark):
    s = "@łukasz hi #tag see http://x.y/z and a.com/b and wp.pl/q x.com  end "
    out = _one(spark, tx.clean_text("t"), s)
    # mention with a Polish letter goes whole, '#' goes, links go, bare x.com stays,
    # whitespace collapses and nothing is trimmed
    assert out == " hi tag see and and x.com end "


def test_clean_text_no_pl_variant(spark):
    assert _one(spark, tx.clean_text("t", strip_pl=False), "a wp.pl/q b") == "a wp.pl/q b"


def test_unicode_whitespace_collapses(spark):
    assert _one(spark, tx.clean_text("t"), "a  b\n\tc") == "a b c"


def test_anchored_link_rule_equals_reference_rule(spark):
    rnd = random.Random(7)
    alphabet = ["a", "b", ".", "com", "pl", " ", "/", "x", "\n", "ą"]
    samples = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["o"] for r in df.select(tx.remove_links("t").alias("o")).collect()]

    def ref(t):
        t = regex.sub(r"http\S+", "", t)
        t = regex.sub(r"\S+\.com\S+", "", t)
        return regex.sub(r"\S+\.pl\S+", "", t)

    assert got == [ref(s) for s in samples]


def test_long_run_without_spaces_is_fast(spark):
    import time

    s = "x" * 30000 + ".comx"
    t0 = time.time()
    assert _one(spark, tx.remove_links("t"), s) == ""
    assert time.time() - t0 < 5


def test_emoji_replacement_is_sequential(spark):
    mapping = [("🙂", "smile"), ("<smile>", "nested"), ("😀", "grin")]
    assert _one(spark, tx.emoji_to_text("t", mapping), "a🙂😀") == "a<nested><grin>"


def test_stopwords_case_sensitive_keep_empty_and_duplicates(spark):
    assert _one(spark, tx.remove_stopwords("t", ["w", "i"]), "W w  i x x") == "W  x x"


def test_tokeniser_unicode_two_chars(spark):
    out = _one(spark, F.array_join(tx.tokenise("t"), "|"), "Zażółć a gęślą_jaźń 12 x3")
    assert out == "zażółć|gęślą_jaźń|12|x3"


def test_length_counts_code_points(spark):
    assert _one(spark, tx.text_length("t"), "😀a") == 2


def test_strip_quotes(spark):
    df = spark.createDataFrame([('"a ""b"" c"',), ('"open',), ('"',), ("plain",)], "t string")
    got = [r["o"] for r in df.select(tx.strip_line_quotes("t").alias("o")).collect()]
    assert got == ['a ""b"" c', '"open', "", "plain"]


def test_annotation_cleaner(spark):
    assert _one(spark, tx.clean_for_annotation("t"), "RT @ann: see https://t.co/x #RT now FAV") == ": see #RT now"


def test_labelled_line_parse_and_missing_label_raises(spark):
    df = spark.createDataFrame([("good text__label__z_plus_m",), ("meh__label__z_amb",)], "value string")
    got = [tuple(r) for r in files.parse_labelled_lines(df).collect()]
    assert got == [("good text", "positive"), ("meh", "ambiguous")]
    bad = spark.createDataFrame([("no marker here",)], "value string")
    with pytest.raises(PySparkException):
        files.parse_labelled_lines(bad).collect()


def test_jsonc_list_and_json_map_order(spark, tmp_path):
    p = tmp_path / "s.jsonc"
    p.write_text('// header\n["a", // first\n "b",\n // "c",\n "d"]\n', encoding="utf-8")
    got = [r["word"] for r in files.read_jsonc_list(spark, str(p)).orderBy("pos").collect()]
    assert got == ["a", "b", "d"]
    m = tmp_path / "m.json"
    m.write_text('{"z": "last letter", "a": "first letter"}', encoding="utf-8")
    got = [(r["k"], r["v"]) for r in files.read_json_map(spark, str(m)).orderBy("pos").collect()]
    assert got == [("z", "last letter"), ("a", "first letter")]


def test_lemma_rebuild_separators(spark):
    from chorus.operators import corpus

    docs = spark.createDataFrame([(1, "Ala ma kota.\nKot ma Ale!"), (2, "\nZ nowej linii")], "id long, t string")
    dic = spark.createDataFrame([("ala", "ala", "subst"), ("ma", "mieć", "fin"), ("kota", "kot", "subst"), ("kot", "kot", "subst"), ("ale", "ala", "subst")], "form string, lemma string, pos string")
    full = {r["id"]: r["lemmatized"] for r in corpus.lemmatize_by_dictionary(docs, "id", "t", dic, "full", True).collect()}
    assert full[1] == "ala mieć kot.\nkot mieć ala!"
    assert full[2] == "Z nowej linii"  # newline in the first sentence is dropped; unknown words keep their form
    nouns = {r["id"]: r["lemmatized"] for r in corpus.lemmatize_by_dictionary(docs, "id", "t", dic, "noun", False).collect()}
    assert nouns[1] == "ala kot\nkot ala"


def test_file_stem_and_indexed_csv(spark, tmp_path):
    assert _one(spark, tx.file_stem("t"), "/a/b/user_tweets.csv") == "user_tweets"
    assert _one(spark, tx.file_stem("t"), "file:///x/y/archive.tar.gz") == "archive.tar"
    p = tmp_path / "t.csv"
    p.write_text(",username,party\n0,a,P\n1,b,Q\n", encoding="utf-8")
    df = files.read_csv_indexed(spark, str(p))
    assert df.columns == ["username", "party"] and df.count() == 2
