import random

import pytest
from pyspark.sql import functions as F

from narrprep.functions import html as H
from narrprep.functions import text as T
from narrprep.functions.abbreviations import (
    ENGLISH,
    SPANISH,
    _set_off,
    apply_rules,
    expand_abbreviations,
    longest_first,
    rule_array,
)
from narrprep.functions.language import with_language
from narrprep.operators.clean import clean_documents
from narrprep.operators.rules import RuleSet


def test_table_sizes():
    assert len(ENGLISH) == 41 and len(SPANISH) == 33


@pytest.mark.parametrize(
    "fn, raw, expected",
    [
        (T.strip, " \u00a0\n a b \x1c\n", "a b"),
        (T.strip, "", ""),
        (T.replace_ligatures, "The ﬁrst ﬂight ﬀ ﬃ ﬅ", "The first flight ff ffi st"),
        (T.plain_characters, "“a”—b… ‘c’\u00a0d\u00ade\ufeff–", "\"a\" - b... 'c' de-"),
        (T.rejoin_hyphenated, "This is a hyphen-\nated word", "This is a hyphenated word"),
        (T.rejoin_hyphenated, "a-\nb-\nc é- \n\n ü", "ab-\nc éü"),
        (T.drop_page_artifacts, "12\nfoo\n Page 3 \n----\n===\nbar\n--\n7", "foo\nbar\n--"),
        (T.drop_page_artifacts, "12\n13", ""),
        (T.drop_page_artifacts, "page 1\npages 2", "pages 2"),
        (T.space_numbers, "$5 €6 555-123-4567 $x", "$ 5 € 6 555, 123, 4567 $x"),
        (T.normalize_punctuation, "a..b!!?? c ( d ) e;f", "a... b!? c (d) e.f"),
        (T.normalize_punctuation, "( (a) ) b", " ( (a) ) b"),
        (T.normalize_punctuation, "example.com a;b", "example. com a.b"),
        (T.normalize_punctuation, "x\n\n(y)", "x (y) "),
        (T.normalize_whitespace, " a\nb\n\n\n\nc \n\n d\n  \ne\t\tf ", "a b\n\nc\n\nd e f"),
        (T.normalize_whitespace, "Too    many   spaces", "Too many spaces"),
        (T.file_label, 'test<>:"/\\|?*file  name', "testfile_name"),
        (T.file_label, "a" * 200, "a" * 100),
        (lambda c: T.preview(c, 3), "abcd", "abc..."),
        (lambda c: T.preview(c, 4), "abcd", "abcd"),
        (T.suffix, "a/b/c.PDF", ".pdf"),
        (T.suffix, "a.b/c", ""),
        (T.suffix, ".hidden", ""),
        (T.stem, "x/y.tar.gz", "y.tar"),
        (T.base_name, "x/y/", "y"),
        (T.without_fragment, "a.html#b#c", "a.html"),
        (H.unescape, "&amp;lt; &copy; &#233; &#x1F600; &#38;amp; &nope; &hellip;", "&lt; © é 😀 &amp; &nope; …"),
        (H.page_title, "<title>\n A &amp; B </title>", "A & B"),
        (
            H.html_to_text,
            "<title>T</title><script>var a='</p>';</script><p>a <b>b</b>\r\n c</p><!-- <p>no</p> --> 1 < 2",
            "T\n\na\n\nb\n\nc\n\n1 < 2",
        ),
    ],
)
def test_text_functions(one, fn, raw, expected):
    assert one(fn, raw) == expected


def test_abbreviations(one):
    en = lambda c: expand_abbreviations(c, F.lit("en"))
    es = lambda c: expand_abbreviations(c, F.lit("es"))
    assert one(en, "Dr. Smith met Prof. Jones on Jan. 5th.") == "Doctor Smith met Professor Jones on January 5th."
    # Longest first, no boundary on the right, none inside a word.
    assert one(en, "Sept. in Mar. éSt. xDr.") == "September in March éSt. xDr."
    # One rule may make room for the next one, as when they run one by one.
    assert one(en, "a.m.t. Dr.St.") == "A Mount DoctorSt."
    assert one(es, "La Sra. y el Dr. de la Cía.") == "La Señora y el Doctor de la Compañía"


def test_abbreviations_that_are_looked_for_first_give_what_all_rules_give(spark):
    # Only these may come up when another rule fires, so the others are tried only where they are in the text.
    assert _set_off(longest_first(SPANISH)) == ["núm.", "etc.", "a.m.", "ej."]
    assert {"Ms.", "Mr.", "Mrs.", "Mt.", "Mar."} < set(_set_off(longest_first(ENGLISH))) < set(ENGLISH)
    rng = random.Random(5)
    pieces = [*ENGLISH, *SPANISH, "s.", "r.", "t.", "ar.", "x", " ", ".", "é", "i.e.g.", "p.m.s. ", "A.M.r.", "Núm. ej."]
    rows = [("".join(rng.choices(pieces, k=rng.randint(1, 9))), k % 2) for k in range(600)]
    rows += [("", 0), (None, 1), ("no dot", 0), ("A dot. And more.", 1)]
    for table, language in ((ENGLISH, "en"), (SPANISH, "es")):
        every = rule_array(longest_first(table), whole_word=False)
        df = spark.createDataFrame(rows, "t string, k int")
        got = df.select("t", expand_abbreviations(F.col("t"), F.lit(language)).alias("got"), apply_rules(F.col("t"), every).alias("want"))
        assert [r for r in got.collect() if r["got"] != r["want"]] == []


def test_literal_rules_with_special_characters(one):
    rules = rule_array([("cat", "C"), ("$x", "D"), ("é", "E")], True)
    assert one(lambda c: apply_rules(c, rules), "cat cats cat. acat a$x $x é café") == "C cats C. acat aD $x E café"


def test_language(spark):
    cases = [
        ("The quick brown fox jumps over the lazy dog. It was the best of times.", "en"),
        ("El perro y la casa de los niños en la calle que es más larga", "es"),
        ("hello", "unknown"),
        ("The quick brown fox jumps over the lazy dog. El perro.", "en"),
        ("one two three four five six", "unknown"),
        ("", "unknown"),
    ]
    rows = with_language(spark.createDataFrame(cases, "text string, expected string")).collect()
    assert [r["detected"] for r in rows] == [r["expected"] for r in rows]


def test_clean_documents(spark):
    raw = spark.createDataFrame(
        [(1, "The  ﬁrst word of the hyphen-\nated text\n12\nis for Dr. Who; it costs $5."), (2, "")],
        "doc_id int, text string",
    )
    got = {r["doc_id"]: r["clean"] for r in clean_documents(raw).collect()}
    assert got == {1: "The first word of the hyphenated text is for Doctor Who. it costs $ 5.", 2: ""}


def test_rules_after_or_before_built_in(spark):
    rules = RuleSet(abbreviations=[("etc.", "and so on")])
    raw = spark.createDataFrame([("a, b etc. c",)], "text string")
    after = clean_documents(raw, rules=rules, language="en").first()["clean"]
    before = clean_documents(raw, rules=rules, rules_first=True, language="en").first()["clean"]
    assert (after, before) == ("a, b etcetera c", "a, b and so on c")


def test_export_header_is_removed_and_body_kept(one):
    ruler = "=" * 60
    text = f"{ruler}\nMETADATA\n{ruler}\ntitle: x\n\n{ruler}\nTEXT\n{ruler}\n\nBody TEXT more"
    assert one(T.strip_export_header, text) == "Body TEXT more"
    assert one(T.strip_export_header, f"{ruler}\nTEXT\n{ruler}\n\nBody") == "Body"
    assert one(T.strip_export_header, "plain TEXT") == "plain TEXT"


def test_progress_line(spark):
    df = spark.createDataFrame(
        [("chunking", 12.5, "go", None), ("chunking", 12.5, "go", "One")], "s string, p double, m string, c string"
    )
    lines = [r[0] for r in df.select(T.progress_line(*[F.col(c) for c in "spmc"])).collect()]
    assert lines == ["[chunking] 12.5% - go", "[chunking] 12.5% - One: go"]


@pytest.mark.parametrize("text", ["a-\nb-\nc d-\n e", "\U0001d49c-\nb", "\U0001f600-\nb", "-\nb", "a--\nb", "a-\nb--\nc", "é-\t\n\n\xa0ü-\nz"])
def test_hyphen_joins_like_the_whole_word_pattern(spark, text):
    word, space = r"[\p{L}\p{N}_]", r"[\p{IsWhite_Space}\x1c-\x1f]"
    whole = rf"(?<!{word})({word}++)-{space}*\n{space}*({word}++)"
    row = spark.createDataFrame([(text,)], "c string").select(
        T.rejoin_hyphenated(F.col("c")).alias("new"), F.regexp_replace("c", whole, "$1$2").alias("old"),
        T.normalize_whitespace(F.lit("a\tb \t c  d e")).alias("blank"),
    ).first()
    assert row.new == row.old and row.blank == "a b c d e"
