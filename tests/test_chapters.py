import re

import pytest
from pyspark.sql import functions as F

from narrprep.operators import chapters as C
from narrprep.operators import sections as S
from narrprep.operators import toc as O

LONG = "word " * 120


def titles(spark, text, compat=False):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r["title"], r["number"]) for r in C.headings(df, ["doc_id"], compat=compat).orderBy("heading_no").collect()]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Chapter 1: Introduction", ("Chapter 1: Introduction", 1)),
        ("  CHAPTER IV - The End ", ("Chapter IV: The End", 4)),
        ("chapter 12", ("Chapter 12", 12)),
        ("Part II.", ("Part II", 2)),
        ("CAPÍTULO 3. Uno", ("Capítulo 3: Uno", 3)),
        ("capitulo x", ("Capítulo x", 10)),
        ("Parte 2", ("Parte 2", 2)),
        ("PRÓLOGO", ("PRÓLOGO", None)),
        ("Epilogue: Later", ("Epilogue: Later", None)),
        ("introducción - algo", ("introducción: algo", None)),
    ],
)
def test_heading_lines(spark, line, expected):
    assert titles(spark, f"text\n{line}\nmore") == [expected]


@pytest.mark.parametrize("line", ["A Chapter 1", "Chapter", "Chapter Long ago", "Introductions follow", "Chapter 1a", "Parts 2"])
def test_other_lines(spark, line):
    assert titles(spark, f"text\n{line}\nmore") == []


def test_without_boundary_in_compat(spark):
    assert titles(spark, "Chapter Long ago\nIntroductions follow", compat=True) == [
        ("Chapter L: ong ago", 50),
        ("Introduction: s follow", None),
    ]


def test_spans_slice_back_to_their_headings(spark):
    text = f"before\n  Chapter 1\n{LONG}\nChapter 2: short\nx\nÉpilogue\nEpilogue\n{LONG}é"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = C.document_chapters(df, ["doc_id"]).orderBy("chapter_no").collect()
    assert [(r["chapter_no"], r["title"]) for r in rows] == [(1, "Chapter 1"), (2, "Epilogue")]
    for r in rows:
        assert text[r["start_char"] : r["end_char"]] == r["chapter_text"]
    # The short chapter belongs to the one before it, and the spans meet.
    assert "Chapter 2: short" in rows[0]["chapter_text"]
    assert rows[0]["end_char"] == rows[1]["start_char"] and rows[1]["end_char"] == len(text)


def test_one_short_chapter_is_kept(spark):
    df = spark.createDataFrame([(1, "Chapter 1\nx"), (2, "none")], "doc_id int, text string")
    assert [(r["doc_id"], r["end_char"]) for r in C.document_chapters(df, ["doc_id"]).collect()] == [(1, 11)]


def test_indented_headings(spark):
    text = "\n   Chapter 1: Introduction\n\n  This is the introduction text.\n\n   Chapter 2: Getting Started\n\n   This is chapter two, and it goes on.\n"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [r["title"] for r in C.document_chapters(df, ["doc_id"], min_length=50).collect()] == [
        "Chapter 1: Introduction", "Chapter 2: Getting Started",
    ]


def test_long_form_spans_equal_in_row_spans(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn(
        "text", F.concat(F.lit("Preface\n"), "text", F.lit("\nChapter 1\nx\nPart 2\n"), "text", F.lit("\nPart 3"))
    )
    a = C.document_chapters(docs, ["doc_id"], keep_text=False)
    b = C.chapter_spans(C.headings(docs, ["doc_id"]), ["doc_id"], block_chars=300).select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_selection_of_missing_chapters_gives_nothing(spark):
    df = spark.createDataFrame([(1, f"Chapter 1\n{LONG}\nChapter 2\n{LONG}")], "doc_id int, text string")
    wanted = lambda *n: F.array(*[F.lit(x) for x in n])
    pick = lambda *n: df.select(C.selected_text(F.col("text"), wanted(*n))).first()[0]
    assert pick(9) is None
    assert pick(2) == f"Chapter 2\n{LONG}"
    assert pick(2, 1) == f"Chapter 1\n{LONG}\n\n\nChapter 2\n{LONG}"
    found = C.document_chapters(df, ["doc_id"], keep_text=False)
    requests = spark.createDataFrame([(1, 2), (1, 7)], "doc_id int, chapter_no int")
    assert [r["chapter_no"] for r in C.select_chapters(found, requests, ["doc_id"]).collect()] == [2]
    rebased = C.rebase_selected(found, ["doc_id"]).orderBy("chapter_no").collect()
    assert [(r["start_char"], r["end_char"]) for r in rebased] == [(0, 611), (613, 1223)]
    assert [r["title"] for r in C.chapter_by_number(found, 2).collect()] == ["Chapter 2"]


def test_positions_before_the_first_chapter(spark):
    chapters = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 20, 20), (1, 3, 20, 30)], "doc_id int, chapter_no int, start_char long, end_char long")
    spots = spark.createDataFrame([(1, p) for p in (0, 9, 10, 19, 20, 29, 30)] + [(2, 5)], "doc_id int, pos long")
    got = {(r["doc_id"], r["pos"]): r["chapter_no"] for r in C.assign_chapters(spots, chapters, ["doc_id"], "pos", 7).collect()}
    assert got == {(1, 0): None, (1, 9): None, (1, 10): 1, (1, 19): 1, (1, 20): 3, (1, 29): 3, (1, 30): None, (2, 5): None}


def test_offsets_index_the_assembled_text(spark):
    texts = ["one", "", "three é", "four", None, "six"]
    rows = [("hot", i, t) for i, t in enumerate(texts)] + [("b", 3, "x")]
    df = spark.createDataFrame(rows, "book string, section_num int, text string")
    blocks = S.assemble(df, ["book"], "section_num", "text", block_rows=2).orderBy("book", "block_no").collect()
    whole = "\n\n".join(r["text"] for r in blocks if r["book"] == "hot")
    assert whole == "one\n\nthree é\n\nfour\n\nsix"
    for r in S.section_offsets(df, ["book"], "section_num", F.length("text"), 2).filter("book = 'hot'").collect():
        assert whole[r["char_offset"] : r["char_offset"] + r["n_chars"]] == texts[r["section_num"]]


def test_blocks_of_a_book_start_at_the_first_section(spark):
    df = spark.createDataFrame([("a", i, str(i)) for i in range(1, 9)], "book string, section_num int, text string")
    blocks = S.assemble(df, ["book"], "section_num", "text", block_rows=4, first=1).orderBy("block_no").collect()
    assert [(r["block_no"], r["n_sections"]) for r in blocks] == [(0, 4), (1, 4)]


def test_toc_levels_and_offsets(spark):
    toc = spark.createDataFrame(
        [("a", 1, " One ", 1), ("a", 2, "Sub", 2), ("a", 1, "Gap", 4), ("a", 1, "Past", 99), ("a", 1, "", 3),
         ("a", 1, "None", 0), ("b", 2, "Two", 1), ("b", 3, "Deep", 1)],
        "book string, level int, title string, section_num int",
    )
    top = C.top_entries(O.valid_entries(toc), ["book"])
    offsets = spark.createDataFrame([("a", 2, 10), ("a", 3, 30), ("a", 5, 50)], "book string, section_num int, char_offset long")
    got = {(r["book"], r["title"]): r["start_char"] for r in C.toc_starts(top, offsets, ["book"], 2).collect()}
    assert got == {("a", "One"): 0, ("a", "Gap"): 30, ("a", "Past"): 50, ("b", "Two"): 0}


def test_flatten_is_depth_first(spark):
    tree = spark.createDataFrame(
        [("a", 1, None, 1, "A"), ("a", 2, 1, 2, "A2"), ("a", 3, 1, 1, "A1"), ("a", 4, 3, 1, "A1a"), ("a", 5, None, 2, "B")],
        "book string, entry_id int, parent_id int, ord int, title string",
    )
    got = O.flatten_toc(tree, ["book"]).orderBy("book", "path").collect()
    assert [(r["title"], r["level"]) for r in got] == [("A", 1), ("A1", 2), ("A1a", 3), ("A2", 2), ("B", 1)]


def test_links_by_address_or_base_name(spark):
    sections = spark.createDataFrame([("a", 1, "text/one.html"), ("a", 2, "text/two.html"), ("a", 3, "more/two.html")], "book string, section_num int, href string")
    links = spark.createDataFrame([("a", 1, "text/two.html#x"), ("a", 2, "two.html"), ("a", 3, "../x/one.html"), ("a", 4, "no.html")], "book string, n int, href string")
    got = {r["n"]: r["section_num"] for r in O.link_sections(links, sections, ["book"]).collect()}
    assert got == {1: 2, 2: 3, 3: 1}


def test_patterns_only_where_there_is_no_toc(spark):
    listed = spark.createDataFrame([(1, "T", 0)], "doc_id int, title string, start_char int")
    found = spark.createDataFrame([(1, "H", 5), (2, "H", 6)], "doc_id int, title string, start_char int")
    got = C.toc_or_headings(listed, found, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"]) for r in got] == [(1, "T"), (2, "H")]


def test_heading_pattern_has_no_line_flag():
    # "^" and "$" with the line flag would also stop at other line breaks.
    from narrprep.functions.headings import heading_start

    assert not re.search(r"\(\?[a-z]*m", heading_start())
