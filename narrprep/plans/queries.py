"""Registered queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.arrays import explode_column, let, running_offsets
from ..functions.abbreviations import expand_abbreviations
from ..functions.html import html_to_text
from ..functions.language import with_language
from ..functions.packing import paragraphs, sentence_pieces
from ..operators import chapters as C
from ..operators import chunks as K
from ..operators import incremental as I
from ..operators import jobs as J
from ..operators import rules as R
from ..operators import sections as S
from ..operators import timeline as L
from ..operators import toc as O
from ..operators import voices as V
from ..operators.observe import observed
from ..operators.clean import clean_documents
from ..operators.scan import number_block
from ..session import stage, work_folder
from ..operators.scoring import paced_model, score_chunks
from ..sources import store as ST
from ..sources.files import with_format
from ..sources.sinks import chapter_listing, export_text, listing_line, write_chunks
from ..sources.tables import html_sections, read_table, read_texts, with_metadata
from ..streaming import feeds as D
from ..streaming import prepare as P
from ..streaming import progress as G
from . import books as BK
from . import inputs as X
from . import narrate as NP

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- language and cleaning -------------------------------------------------


@query
def detect_language(spark, sf) -> DataFrame:
    return with_language(X.documents(spark, sf), keep_counts=True).select(
        "doc_id", "n_words", "es_hits", "en_hits", "detected"
    )


@query
def language_confusion(spark, sf) -> DataFrame:
    return with_language(X.documents(spark, sf)).groupBy("lang", "detected").agg(F.count("*").alias("n_docs"))


@query
def clean_text(spark, sf) -> DataFrame:
    return clean_documents(X.damaged(spark, sf)).select("doc_id", "detected", "clean")


@query
def page_artifacts(spark, sf) -> DataFrame:
    lines = F.replace(F.col("text"), F.lit("\n"), F.lit("\n  12 \nPage  7\n=====\n--\n"))
    return X.documents(spark, sf).select("doc_id", T.drop_page_artifacts(lines).alias("clean"))


@query
def hyphen_rejoin(spark, sf) -> DataFrame:
    cut = F.replace(F.col("text"), F.lit(", "), F.lit("- \n "))
    return X.documents(spark, sf).select("doc_id", T.rejoin_hyphenated(cut).alias("clean"))


@query
def abbrev_expand(spark, sf) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit(", "), F.lit(", Dr. Sra. no etc. at 5 p.m. (Sept. 3, vs. S.A.) "))
    return X.documents(spark, sf).select(
        "doc_id", expand_abbreviations(marked, F.col("lang")).alias("clean")
    )


@query
def punctuation_spacing(spark, sf) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit(", "), F.lit("....then!!what??(so )$5;€6 call 555-123-4567.ok"))
    clean = T.normalize_whitespace(T.normalize_punctuation(T.space_numbers(marked)))
    return X.documents(spark, sf).select("doc_id", clean.alias("clean"))


# --- rules -----------------------------------------------------------------


@query
def rules_apply(spark, sf) -> DataFrame:
    rows = [("demo", 0, kind, key, value, i) for i, (kind, key, value) in enumerate(X.DEMO_RULES)]
    rules = R.RuleSet.from_table(spark.createDataFrame(rows, R.RULE_SCHEMA))
    marked = F.replace(F.col("text"), F.lit(", "), F.lit(", no. 5km of SQL for $30 and approx. NATO, "))
    return X.documents(spark, sf).select("doc_id", rules.apply(marked).alias("clean"))


@query
def rules_dictionary(spark, sf) -> DataFrame:
    """A dictionary of all words of the benchmark items, thousands, applied to all documents."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    keys = read_table(spark, sf, "benchmark").select(words.alias("key")).filter(F.length("key") > 3).distinct()
    rules = keys.select(
        F.lit("benchmark").alias("dict_id"), F.lit(0).alias("priority"), F.lit("words").alias("kind"), "key",
        F.concat(F.lit("W"), F.length("key").cast("string"), F.substring("key", 1, 2)).alias("replacement"), F.lit(0).alias("ord"),
    )
    spoken = R.RuleSet.from_table(rules, most=1_000_000)
    return X.documents(spark, sf).select("doc_id", spoken.apply(F.col("text")).alias("clean"))


@query
def observed_cleaning(spark, sf) -> DataFrame:
    """What an observer counted while documents were detected and written, one row per language beside its counts."""
    found = with_language(X.documents(spark, sf))
    counted, watch = observed(
        found.select("doc_id", "detected", F.length("text").cast("bigint").alias("n_chars")), "cleaning",
        chars=F.sum("n_chars"), longest=F.max("n_chars"), english=F.count_if(F.col("detected") == "en"),
    )
    rows = stage(counted, "observed")
    seen = watch.get
    return rows.groupBy("detected").agg(F.count("*").alias("n_docs")).select(
        "detected", "n_docs",
        *[F.lit(seen[k]).cast("bigint").alias(f"seen_{k}") for k in ("rows", "chars", "longest", "english")],
    )


@query
def rules_merge(spark, sf) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    words = F.split(F.col("text"), " ")
    rules = turns.select(
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("dict_id"),
        F.col("turn").cast("int").alias("priority"),
        F.when(F.col("role") == "user", "words")
        .when(F.col("role") == "assistant", "acronyms")
        .otherwise("patterns")
        .alias("kind"),
        words[0].alias("key"),
        F.element_at(words, -1).alias("replacement"),
        F.col("conv_id").cast("int").alias("ord"),
    )
    return R.merge_rules(rules)


# --- markup and sections ---------------------------------------------------


@query
def html_text(spark, sf) -> DataFrame:
    return html_sections(read_texts(spark, sf, "pages")).select("page_id", "text")


@query
def page_metadata(spark, sf) -> DataFrame:
    return with_metadata(read_texts(spark, sf, "pages")).select(
        "page_id", F.col("metadata.title").alias("title"), F.col("metadata.author").alias("author"),
        F.col("metadata.page_count").cast("bigint").alias("page_count"),
    )


@query
def site_sections(spark, sf) -> DataFrame:
    """Pages as sections of the site they belong to, with their offsets."""
    pages = read_texts(spark, sf, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        F.col("page_id").alias("section_num"),
        F.length(html_to_text(F.col("html"))).alias("n"),
    )
    return S.section_offsets(stage(pages, "site-lengths"), ["host"], "section_num", F.col("n"), block_rows=256)


@query
def section_offsets(spark, sf) -> DataFrame:
    return S.section_offsets(X.section_lengths(spark, sf), ["source"], "doc_id", F.col("n_chars"), block_rows=256)


@query
def conversation_assemble(spark, sf) -> DataFrame:
    return S.assemble(read_table(spark, sf, "conversations"), ["conv_id"], "turn", "text")


@query
def book_assemble(spark, sf) -> DataFrame:
    return S.assemble(X.documents(spark, sf), ["source"], "doc_id", "text", block_rows=512)


# --- chapters --------------------------------------------------------------


@query
def headings(spark, sf) -> DataFrame:
    return C.headings(X.books(spark, sf), ["doc_id"]).drop("text_chars")


@query
def chapter_spans(spark, sf) -> DataFrame:
    return C.document_chapters(X.books(spark, sf), ["doc_id"], keep_text=False)


@query
def chapter_text(spark, sf) -> DataFrame:
    return C.document_chapters(X.books(spark, sf), ["doc_id"]).select("doc_id", "chapter_no", "chapter_text")


def _source_headings(spark, sf) -> DataFrame:
    """Headings of the source books with starts in the whole book; one pass over the texts."""
    sections = X.source_sections(spark, sf).select(
        "source",
        "section_num",
        F.length("text").alias("n"),
        C.heading_array(F.col("text")).alias("found"),
    )
    sections = stage(sections, "section-headings")
    offsets = S.section_offsets(sections, ["source"], "section_num", F.col("n"), block_rows=256)
    totals = sections.groupBy("source").agg((F.sum(F.col("n") + 2) - 2).cast("bigint").alias("text_chars"))
    placed = (
        explode_column(sections, ["source", "section_num"], "found", "i", "h")
        .join(offsets, ["source", "section_num"])
        .join(totals, "source")
        .select(
            "source",
            "section_num",
            (F.col("h.start_char") + F.col("char_offset")).alias("start_char"),
            "h.title",
            "h.number",
            "text_chars",
        )
    )
    return stage(placed, "book-headings")


@query
def book_chapters(spark, sf) -> DataFrame:
    """Chapters of books whose text is many rows, with starts in the whole book."""
    return C.chapter_spans(_source_headings(spark, sf), ["source"], block_chars=50_000).select(
        "source", "section_num", "chapter_no", "title", "number", "start_char", "end_char"
    )


@query
def chapter_select(spark, sf) -> DataFrame:
    found = C.document_chapters(X.books(spark, sf), ["doc_id"], keep_text=False)
    requests = X.labels(spark, sf).select("doc_id", (F.col("quality") + F.col("toxic") + 1).alias("chapter_no"))
    return C.select_chapters(found, requests, ["doc_id"]).select("doc_id", "chapter_no", "title", "start_char")


@query
def chapter_select_text(spark, sf) -> DataFrame:
    wanted = X.labels(spark, sf).select(
        "doc_id", F.array(F.col("quality") + 1, F.col("toxic") * 2 + 3).cast("array<int>").alias("wanted")
    )
    return X.books(spark, sf).join(wanted, "doc_id").select(
        "doc_id", C.selected_text(F.col("text"), F.col("wanted")).alias("text")
    )


@query
def chapter_rebase(spark, sf) -> DataFrame:
    found = C.document_chapters(X.books(spark, sf), ["doc_id"], keep_text=False)
    later = found.join(X.labels(spark, sf), "doc_id").filter(F.col("chapter_no") > F.col("quality"))
    return C.rebase_selected(later, ["doc_id"]).select("doc_id", "chapter_no", "start_char", "end_char")


@query
def chapter_by_number(spark, sf) -> DataFrame:
    found = C.document_chapters(X.books(spark, sf), ["doc_id"], keep_text=False)
    return C.chapter_by_number(found, F.col("doc_id").cast("int")).select("doc_id", "title", "number")


@query
def chapter_titles(spark, sf) -> DataFrame:
    found = C.heading_array(F.col("text"))
    return X.books(spark, sf).select(
        "doc_id", F.array_join(F.transform(found, lambda h: h["title"]), " | ").alias("titles")
    )


@query
def paragraph_chapter(spark, sf) -> DataFrame:
    books = X.books(spark, sf)
    placed = let(
        paragraphs(F.col("text")),
        lambda p: F.arrays_zip(
            F.transform(p, F.length).alias("n"), running_offsets(F.transform(p, F.length), 2).alias("pos")
        ),
    )
    rows = books.select("doc_id", F.posexplode(placed).alias("para_idx", "z")).select(
        "doc_id", "para_idx", F.col("z.pos").alias("para_pos")
    )
    found = C.document_chapters(books, ["doc_id"], keep_text=False)
    return C.assign_chapters(stage(rows, "paragraphs"), stage(found, "chapters"), ["doc_id"], "para_pos")


@query
def toc_offsets(spark, sf) -> DataFrame:
    docs = X.documents(spark, sf)
    toc = docs.join(X.labels(spark, sf), "doc_id").select(
        "source",
        F.col("doc_id").alias("entry_id"),
        (F.lit(2) - F.col("toxic")).cast("int").alias("level"),
        F.concat(F.lit(" About "), "lang").alias("title"),
        (F.col("doc_id") + F.col("quality") * 3 - 2).alias("section_num"),
    )
    top = C.top_entries(O.valid_entries(toc), ["source"])
    lengths = X.section_lengths(spark, sf)
    offsets = S.section_offsets(lengths, ["source"], "doc_id", F.col("n_chars"), block_rows=256)
    return C.toc_starts(top, offsets.withColumnRenamed("doc_id", "section_num"), ["source"], block_sections=256)


@query
def toc_flatten(spark, sf) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    tree = turns.select(
        "conv_id",
        (F.col("turn") + 1).alias("entry_id"),
        F.when(F.col("turn") > 0, F.floor((F.col("turn") + 1) / 2)).cast("bigint").alias("parent_id"),
        (F.lit(100) - F.col("turn")).cast("bigint").alias("ord"),
        F.col("role").alias("title"),
    )
    return O.flatten_toc(tree, ["conv_id"]).select("conv_id", "entry_id", "level", "path", "title")


@query
def toc_href_join(spark, sf) -> DataFrame:
    pages = read_texts(spark, sf, "pages").select(
        F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("site"),
        F.col("page_id").alias("section_num"),
        F.regexp_extract("url", r"^[^?#]*", 0).alias("href"),
    )
    exact = F.when(F.col("section_num") % 2 == 0, F.col("href"))
    target = F.coalesce(exact, F.concat(F.lit("text/"), T.base_name(F.col("href"))))
    links = pages.select(
        "site", F.col("section_num").alias("entry_id"),
        F.when(F.col("section_num") % 5 == 4, F.lit("gone.html")).otherwise(F.concat(target, F.lit("#top"))).alias("href"),
    )
    return O.link_sections(links, pages, ["site"]).select("site", "entry_id", "section_num")


@query
def toc_or_headings(spark, sf) -> DataFrame:
    """Chapters of labelled books by their table of contents, of the others by headings."""
    books = X.books(spark, sf)
    by_toc = X.labels(spark, sf).select(
        "doc_id", F.lit("Listed").alias("title"), (F.col("quality") * 10).cast("bigint").alias("start_char")
    )
    by_heading = C.headings(books, ["doc_id"]).select("doc_id", "title", "start_char")
    return C.toc_or_headings(by_toc, by_heading, ["doc_id"])


# --- sentences and chunks --------------------------------------------------


@query
def sentences(spark, sf) -> DataFrame:
    return K.sentence_rows(X.paragraphed(spark, sf), ["doc_id"])


@query
def split_long(spark, sf) -> DataFrame:
    """Sentences, those of more than 120 characters in parts."""
    pieces = F.flatten(F.transform(paragraphs(F.col("text")), lambda p: sentence_pieces(p, 120)))
    return (
        X.documents(spark, sf)
        .select("doc_id", F.posexplode(pieces).alias("piece_idx", "x"))
        .select("doc_id", "piece_idx", F.col("x.t").alias("piece"), F.col("x.solo").alias("cut"))
    )


@query
def pack_chunks(spark, sf) -> DataFrame:
    packed = K.packed_chunks(F.col("text"))
    return X.paragraphed(spark, sf).select("doc_id", F.posexplode(packed).alias("chunk_idx", "x")).select(
        "doc_id", "chunk_idx", F.col("x.text").alias("text"), F.col("x.para_idx").alias("para_idx"),
        F.col("x.paragraph_break_after").alias("paragraph_break_after"),
    )


@query
def merge_short(spark, sf) -> DataFrame:
    return K.chunk_documents(X.paragraphed(spark, sf), ["doc_id"]).drop("para_pos")


@query
def chunk_durations(spark, sf) -> DataFrame:
    chunks = K.chunk_documents(X.paragraphed(spark, sf), ["doc_id"])
    return L.with_durations(chunks, speed=1.25).select("doc_id", "chunk_idx", "n_words", "n_samples")


# --- timeline --------------------------------------------------------------

BOOK_ORDER = ["doc_id", "para_idx", "sent_idx"]


def _book_chunks(spark, sf) -> DataFrame:
    return stage(X.book_chunks(spark, sf), "book-chunks")


def _book_timeline(spark, sf) -> DataFrame:
    chunks = _book_chunks(spark, sf)
    return L.timeline(chunks, ["source"], BOOK_ORDER, number_block("doc_id", 64))


@query
def timeline(spark, sf) -> DataFrame:
    return _book_timeline(spark, sf).select(
        "source", *BOOK_ORDER, "chapter_no", "n_samples", "chapter_change", "start_sample", "total_samples", "percent"
    )


def _book_markers(spark, sf) -> DataFrame:
    lines = stage(_book_timeline(spark, sf).filter("chapter_change"), "book-openings")
    return L.chapter_markers(lines, ["source"], BOOK_ORDER, number_block("doc_id", 64), lines.count())


@query
def chapter_markers(spark, sf) -> DataFrame:
    return _book_markers(spark, sf)


@query
def book_narration(spark, sf) -> DataFrame:
    """Books whose sections are many rows, from texts to chunks with chapter and place in time."""
    sections = X.source_sections(spark, sf).withColumn("text", F.concat("text", F.lit("\n\nOh."), F.lit("\n\n"), F.col("section_num").cast("string")))
    told = BK.narrate_books(sections, ["source"], "section_num", block_rows=64)
    return told.select("source", "chunk_idx", "text", "para_idx", "chapter_no", "n_samples", "start_sample", "total_samples")


@query
def marker_metadata(spark, sf) -> DataFrame:
    titled = _book_markers(spark, sf).withColumn(
        "title", F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string"))
    )
    return L.marker_metadata(titled, ["source"], block_markers=16)


@query
def duration_by_source(spark, sf) -> DataFrame:
    return L.book_totals(_book_timeline(spark, sf), ["source"])


@query
def proportional_markers(spark, sf) -> DataFrame:
    lengths = X.section_lengths(spark, sf)
    starts = S.section_offsets(lengths, ["source"], "doc_id", F.col("n_chars"), block_rows=256).select(
        "source", F.col("doc_id").alias("chapter_no"), F.col("char_offset").alias("start_char")
    )
    totals = lengths.groupBy("source").agg(
        (F.sum(F.col("n_chars") + 2) - 2).cast("bigint").alias("total_chars"),
        F.sum("n_samples").alias("total_samples"),
    )
    return L.proportional_markers(starts, totals, ["source"], block_chapters=256).select(
        "source", "chapter_no", "start_sample"
    )


@query
def synthesize_batch(spark, sf) -> DataFrame:
    rows = X.paragraph_rows(spark, sf).filter(T.strip(F.col("text")) != "")
    return L.with_durations(rows).groupBy("doc_id").agg(
        F.count("*").alias("n_texts"), F.sum("n_samples").alias("n_samples")
    )


@query
def score_model(spark, sf) -> DataFrame:
    rows = X.paragraph_rows(spark, sf).select(
        "doc_id", "chunk_idx", "text", F.lit("af_heart").alias("voice"), F.lit(1.0).alias("speed")
    )
    return score_chunks(rows, paced_model).select("doc_id", "chunk_idx", "n_samples")


@query
def document_totals(spark, sf) -> DataFrame:
    docs = X.books(spark, sf)
    per_doc = docs.select(
        "source",
        "lang",
        F.length("text").alias("n_chars"),
        T.word_count(F.col("text")).alias("n_words"),
        F.size(paragraphs(F.col("text"))).alias("n_paragraphs"),
        F.size(C.heading_array(F.col("text"))).alias("n_headings"),
    )
    return per_doc.groupBy("source", "lang").agg(
        F.count("*").alias("n_docs"),
        *[F.sum(c).alias(c) for c in ("n_chars", "n_words", "n_paragraphs", "n_headings")],
    )


# --- whole plan ------------------------------------------------------------


@query
def narration_summary(spark, sf) -> DataFrame:
    return NP.narration_summary(NP.narrate(X.books(spark, sf)))


@query
def narration_chunks(spark, sf) -> DataFrame:
    return NP.narration_chunks(NP.narrate(X.books(spark, sf)))


@query
def narration_markers(spark, sf) -> DataFrame:
    return NP.narration_markers(NP.narrate(X.books(spark, sf)))


# --- scalar functions ------------------------------------------------------


@query
def roman_numerals(spark, sf) -> DataFrame:
    letters = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "IVXLCDMIVA")
    return read_table(spark, sf, "orders").select(
        "o_orderkey", letters.alias("numeral"), N.roman_to_int(letters).cast("bigint").alias("value"),
        N.chapter_number(F.col("o_orderkey").cast("string")).cast("bigint").alias("number"),
    )


@query
def format_duration(spark, sf) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        "o_orderkey",
        N.clock_millis(F.col("o_totalprice")).alias("clock_millis"),
        N.clock(F.col("o_totalprice")).alias("clock"),
    )


@query
def content_fingerprint(spark, sf) -> DataFrame:
    return X.documents(spark, sf).select(
        "doc_id",
        N.content_fingerprint(F.col("text")).alias("input_hash"),
        F.lit(X.RUN_HASH).alias("settings_hash"),
        N.chunk_label(F.col("doc_id")).alias("label"),
    )


@query
def filename_labels(spark, sf) -> DataFrame:
    name = F.concat(F.col("source"), F.lit('/<a>: "b"? '), F.col("text"))
    return X.documents(spark, sf).select("doc_id", T.file_label(name).alias("label"))


@query
def url_parts(spark, sf) -> DataFrame:
    plain = T.without_fragment(F.split("url", r"\?")[0])
    return read_texts(spark, sf, "pages").select(
        "page_id",
        T.base_name(plain).alias("name"),
        T.stem(plain).alias("stem"),
        T.suffix(plain).alias("suffix"),
    )


@query
def preview_text(spark, sf) -> DataFrame:
    return clean_documents(X.damaged(spark, sf)).select(
        "doc_id",
        "detected",
        T.preview(F.col("clean"), 1000).alias("preview"),
        F.length("clean").cast("bigint").alias("total_chars"),
        (F.length("clean") > 1000).alias("truncated"),
    )


@query
def format_routing(spark, sf) -> DataFrame:
    extension = (
        F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".EPUB").when(F.col("lang") == "de", ".wav").otherwise("")
    )
    files = X.documents(spark, sf).select(
        F.concat(F.lit("/in/"), "source", F.lit("/book"), F.col("doc_id").cast("string"), extension).alias("path")
    )
    return with_format(files)


# --- listings and exports --------------------------------------------------


@query
def chapter_list(spark, sf) -> DataFrame:
    found = C.document_chapters(X.books(spark, sf), ["doc_id"], keep_text=False).withColumn(
        "start_section", F.when(F.col("chapter_no") > 1, F.col("chapter_no") * 10)
    )
    return chapter_listing(found, ["doc_id"], unit="section")


@query
def text_export(spark, sf) -> DataFrame:
    none = F.lit(None).cast("int")
    listing = F.transform(
        C.chapter_array(F.col("text")), lambda c, i: listing_line(i + F.lit(1), c["title"], none)
    )
    meta = F.struct(
        F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("author"),
        F.lit("").alias("subject"), F.col("lang").alias("creator"), F.lit("").alias("producer"), F.lit(1).alias("page_count"),
    )
    return (
        X.books(spark, sf)
        .select("doc_id", "text", meta.alias("metadata"), listing.alias("listing"))
        .select("doc_id", export_text("metadata", "listing", "text").alias("export"))
    )


@query
def export_header(spark, sf) -> DataFrame:
    """Bodies of exported texts, header blocks removed again."""
    return text_export(spark, sf).select("doc_id", T.strip(T.strip_export_header(F.col("export"))).alias("body"))


# --- incremental runs ------------------------------------------------------


def _done(spark, sf) -> DataFrame:
    good = X.labels(spark, sf).filter("quality = 1").select("doc_id", "toxic")
    rows = X.paragraph_rows(spark, sf).join(good, "doc_id")
    stale = F.when(F.col("toxic") == 1, F.lit(X.OLD_HASH)).otherwise(F.col("settings_hash"))
    return rows.withColumn("settings_hash", stale).drop("toxic")


@query
def pending_chunks(spark, sf) -> DataFrame:
    return I.pending(X.paragraph_rows(spark, sf), _done(spark, sf)).select("doc_id", "chunk_idx", "text")


def _partly_done(spark, sf) -> DataFrame:
    """Chunk keys of an earlier run that made all chunks of some documents and some chunks of others."""
    return _done(spark, sf).filter("doc_id % 2 = 1 or chunk_idx % 3 > 0").select(*I.CHUNK_KEY)


@query
def resume_chunks(spark, sf) -> DataFrame:
    """What an interrupted run still has to make; only texts of documents that are not finished are cut."""
    docs = X.paragraphed(spark, sf).select("doc_id", "text")
    inputs = stage(I.input_manifest(docs, X.RUN_HASH), "resume-inputs")
    done = stage(_partly_done(spark, sf), "resume-done")
    totals = X.paragraph_rows(spark, sf).groupBy(*I.RUN_KEY).agg(F.count("chunk_idx").alias("total_chunks"))
    runs = stage(I.run_manifest(done, totals), "resume-runs")

    def cut(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("chunk_idx", "text"))

    return I.resume_chunks(docs, inputs, runs, done, cut).select("doc_id", "chunk_idx", "text")


@query
def run_manifests(spark, sf) -> DataFrame:
    """Chunks made and to make of every run, and whether it is unfinished."""
    done = _partly_done(spark, sf)
    rows = X.paragraph_rows(spark, sf)
    totals = rows.groupBy(*I.RUN_KEY).agg(F.count("chunk_idx").alias("total_chunks"))
    runs = stage(I.run_manifest(done, totals), "manifest-runs")
    todo = I.unfinished(totals, runs).select("doc_id", "started")
    return runs.join(todo, "doc_id", "left").select(
        "doc_id", "done_chunks", "total_chunks", F.col("started").isNotNull().alias("unfinished"), F.coalesce("started", F.lit(False)).alias("started")
    )


def _stored(spark, sf) -> str:
    """Chunks stored in four runs: all; some documents anew; some emptied; and some more behind a compaction."""
    path = work_folder(spark, "store-query")
    rows = stage(X.paragraph_rows(spark, sf).select("doc_id", "chunk_idx", "text"), "store-rows")
    again = lambda rest, mark: rows.filter(F.col("doc_id") % 50 == rest).withColumn("text", F.concat("text", F.lit(mark)))
    ST.append_run(rows, path)
    ST.append_run(again(3, "!").filter("chunk_idx % 2 = 0"), path)
    ST.append_run(again(7, "?").filter("false"), path, documents=again(7, "?").select("doc_id").distinct())
    ST.compact(spark, path)
    ST.append_run(again(3, ";").unionByName(again(9, ";")).filter("chunk_idx < 3"), path)
    return path


@query
def store_and_read(spark, sf) -> DataFrame:
    return ST.read_store(spark, _stored(spark, sf)).select("doc_id", "chunk_idx", "text")


@query
def store_manifest(spark, sf) -> DataFrame:
    """Documents of the store as its newest run holds them."""
    return ST.stored_documents(spark, _stored(spark, sf)).filter("not replaced").select("doc_id", "run_no", "n_rows")


@query
def recover_missing(spark, sf) -> DataFrame:
    stored = X.paragraph_rows(spark, sf).filter(F.length("text") > 100)
    return I.recover(_done(spark, sf), stored).select("doc_id", "chunk_idx", "settings_hash")


@query
def resume_verify(spark, sf) -> DataFrame:
    docs = X.documents(spark, sf).select(
        "doc_id", N.content_fingerprint(F.col("text")).alias("input_hash"), F.lit(X.RUN_HASH).alias("settings_hash"), "text"
    )
    runs = docs.join(X.labels(spark, sf), "doc_id").select(
        "doc_id",
        F.when((F.col("quality") == 0) & (F.col("toxic") == 1), 2).otherwise(1).alias("version"),
        F.when(F.col("quality") == 1, F.col("input_hash"))
        .otherwise(N.content_fingerprint(F.concat("text", F.lit("!"))))
        .alias("input_hash"),
        F.when(F.col("toxic") == 1, F.lit(X.OLD_HASH)).otherwise(F.lit(X.RUN_HASH)).alias("settings_hash"),
    )
    return I.verify_runs(docs, runs)


@query
def progress_percent(spark, sf) -> DataFrame:
    rows = X.paragraph_rows(spark, sf)
    done = rows.filter(F.length("text") > 200)
    return I.run_progress(rows, done, ["doc_id"], "chunk_idx")


@query
def commit_and_read(spark, sf) -> DataFrame:
    """All chunks are written, those of every third document once more with another text, and all read back."""
    path = work_folder(spark, "commit-query")
    rows = X.paragraph_rows(spark, sf).select("doc_id", "chunk_idx", "text")
    write_chunks(rows, path, buckets=16)
    again = rows.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!")))
    write_chunks(again, path, buckets=16)
    return spark.read.parquet(path).select("doc_id", "chunk_idx", "text")


@query
def spoken_seconds(spark, sf) -> DataFrame:
    return X.documents(spark, sf).select("doc_id", F.round(N.spoken_seconds(F.col("text")), 6).alias("seconds"))


# --- job log ---------------------------------------------------------------

STATE = ["status", "stage", "percent", "chunk", "message", "ts"]


@query
def latest_state(spark, sf) -> DataFrame:
    return J.latest_state(X.job_log(spark, sf), STATE)


@query
def job_view(spark, sf) -> DataFrame:
    return J.current_view(X.job_log(spark, sf)).select(
        "job_id", "status", F.col("progress.stage").alias("stage"), F.col("progress.percent").alias("percent"),
        F.col("progress.chunk").alias("chunk"), F.col("progress.message").alias("message"),
    )


@query
def progress_changes(spark, sf) -> DataFrame:
    log = X.job_log(spark, sf)
    return J.progress_changes(log, ["status", "stage"]).select("job_id", "event_id", "status", "stage")


@query
def state_changes(spark, sf) -> DataFrame:
    return J.progress_changes(X.job_log(spark, sf)).select("job_id", "event_id", *J.CHANGE_FIELDS)


@query
def open_stalls(spark, sf) -> DataFrame:
    return J.open_stalls(X.job_log(spark, sf), 3600.0).select("job_id", "status", "ts", "silent_us")


@query
def job_feed(spark, sf) -> DataFrame:
    """Updates of every job up to the one that ends it."""
    return J.until_terminal(X.job_log(spark, sf)).select("job_id", "event_id", "status")


@query
def stalled_jobs(spark, sf) -> DataFrame:
    return J.stalled(X.job_log(spark, sf), 6 * 3600.0).select("job_id", "event_id", "ts", "next_ts", "gap_us")


@query
def illegal_transitions(spark, sf) -> DataFrame:
    return J.illegal_transitions(X.job_log(spark, sf)).select("job_id", "event_id", "from_status", "status")


@query
def job_timings(spark, sf) -> DataFrame:
    return J.job_timings(X.job_log(spark, sf))


@query
def jobs_page(spark, sf) -> DataFrame:
    return J.job_pages(X.jobs(spark, sf), limit=5, offset=2).select("user_id", "row_no", "job_id", "created_at")


@query
def user_jobs(spark, sf) -> DataFrame:
    return J.list_jobs(X.jobs(spark, sf), 7, limit=10, offset=1).select("user_id", "job_id", "created_at")


@query
def own_job(spark, sf) -> DataFrame:
    """A job is found by its owner only."""
    jobs = X.jobs(spark, sf)
    mine = J.owned_job(jobs, 7, jobs["user_id"]).withColumn("asked_by", F.lit("owner"))
    other = J.owned_job(jobs, 7, jobs["user_id"] + 1).withColumn("asked_by", F.lit("other"))
    return mine.unionByName(other).select("job_id", "user_id", "asked_by")


@query
def pending_jobs(spark, sf) -> DataFrame:
    accepted, _ = J.split_requests(J.pending_jobs(X.jobs(spark, sf)))
    return accepted.select("job_id", "user_id", "speed")


@query
def rejected_requests(spark, sf) -> DataFrame:
    _, rejected = J.split_requests(X.jobs(spark, sf))
    return rejected.select("job_id", "speed")


@query
def requested_chapters(spark, sf) -> DataFrame:
    return J.requested_chapters(X.jobs(spark, sf), ["job_id"])


@query
def job_create(spark, sf) -> DataFrame:
    requests = X.jobs(spark, sf).select(
        "user_id",
        F.concat(F.lit("uploads/"), F.col("user_id").cast("string"), F.lit("/book "), F.col("job_id").cast("string"), F.lit(".EPUB")).alias("upload_key"),
        "created_at",
        F.coalesce(F.from_json("chapters_to_convert", "array<int>"), F.array().cast("array<int>")).alias("chapters"),
    )
    return J.new_jobs(requests).drop("job_id", "created_at")


@query
def job_updates(spark, sf) -> DataFrame:
    flag = F.min("l_returnflag")
    updates = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.when(flag == "A", "cancelled").when(flag == "N", "processing").otherwise("completed").alias("to_status")
    )
    return J.apply_updates(X.jobs(spark, sf), updates)


@query
def job_update_log(spark, sf) -> DataFrame:
    """Every event as an update of its job, which begins as pending; many are refused."""
    log = X.job_log(spark, sf)
    updates = log.select("job_id", "ts", "event_id", F.when(F.col("chunk") % 4 == 0, "cancelled").otherwise(F.col("status")).alias("to_status"))
    current = log.filter("job_id % 5 > 0").select("job_id").distinct().withColumn("status", F.lit("pending"))
    return J.apply_update_log(current, updates).select("job_id", "event_id", "from_status", "status", "percent", "refused")


@query
def update_times(spark, sf) -> DataFrame:
    return X.job_log(spark, sf).select("event_id", N.iso_utc(F.col("ts")).alias("updated_at"))


@query
def job_owners(spark, sf) -> DataFrame:
    owners = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("owner")
    )
    counts = X.jobs(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "completed").alias("n_completed")
    )
    return counts.join(owners, "user_id").select("user_id", "owner", "n_jobs", "n_completed")


@query
def progress_json(spark, sf) -> DataFrame:
    return J.progress_json(X.job_log(spark, sf), ["event_id", "status", "stage", "percent", "chunk", "message"])


@query
def progress_lines(spark, sf) -> DataFrame:
    log = X.job_log(spark, sf)
    chapter = F.when(F.col("chunk") % 2 == 0, F.concat(F.lit("Chapter "), F.col("chunk").cast("string")))
    tenth = F.round(F.col("percent") * 2, 0) / 2
    return log.select("event_id", T.progress_line(F.col("stage"), tenth, F.col("message"), chapter).alias("line"))


# --- voices ----------------------------------------------------------------


def _voiced(spark, sf) -> DataFrame:
    voice = (
        F.when(F.col("lang") == "en", F.when(F.col("n_chars") > 1000, "am_adam").otherwise("bf_emma"))
        .when(F.col("lang") == "es", "ef_dora")
        .when(F.col("lang") == "fr", F.concat(F.lit("ff_"), "source"))
        .otherwise("xx_none")
    )
    return X.documents(spark, sf).select("doc_id", voice.alias("voice"))


@query
def voice_routing(spark, sf) -> DataFrame:
    return V.route_voices(_voiced(spark, sf)).select("doc_id", "voice", "lang_code", "lang_name", "description")


@query
def voices_by_language(spark, sf) -> DataFrame:
    return V.route_voices(_voiced(spark, sf)).groupBy("lang_code", "lang_name", "voice").agg(
        F.count("*").alias("n_docs")
    )


@query
def voices_of_language(spark, sf) -> DataFrame:
    used = V.voices_by_language(V.route_voices(_voiced(spark, sf)))
    return used.select("lang_code", "lang_name", F.array_join("voices", ",").alias("voices"))


# --- streams ---------------------------------------------------------------


@query
def stream_prepare(spark, sf) -> DataFrame:
    stream = P.file_stream(spark, sf, "documents")

    def prepare(batch: DataFrame) -> DataFrame:
        texts = batch.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
        return K.chunk_documents(texts, ["doc_id"]).drop("para_pos")

    return P.prepared_table(spark, stream, prepare, "prepared")


@query
def stream_changes(spark, sf) -> DataFrame:
    stream = X.as_job_log(P.file_stream(spark, sf, "events"))
    return D.change_table(spark, stream, X.job_log(spark, sf), "1 hour", ["status", "stage"]).select(
        "job_id", "event_id", "status", "stage"
    )


@query
def stream_done(spark, sf) -> DataFrame:
    """The last row of the feed of every job that ended: how long it ran, or why it failed."""
    stream = X.as_job_log(P.file_stream(spark, sf, "events"))
    ends = D.done_table(spark, stream, X.job_log(spark, sf), "1 hour")
    return ends.select(
        "job_id", "event_id", "status",
        F.when(F.col("status") == "completed", F.round("run_seconds", 3)).alias("duration_seconds"),
        F.when(F.col("status") == "failed", F.col("message")).alias("error_message"),
    )


@query
def stream_silent(spark, sf) -> DataFrame:
    """Gaps of more than six hours, and jobs that are silent for so long at the end of the log."""
    stream = X.as_job_log(P.file_stream(spark, sf, "events"))
    found = D.stall_table(spark, stream, X.job_log(spark, sf), "1 hour", 6 * 3600.0)
    return found.select("job_id", "event_id", "status", "ts", "next_ts", "gap_us")


@query
def stream_latest(spark, sf) -> DataFrame:
    stream = X.as_job_log(P.file_stream(spark, sf, "events"))
    return G.latest_table(spark, stream, STATE)


@query
def stream_dedup(spark, sf) -> DataFrame:
    stream = X.as_job_log(P.file_stream(spark, sf, "events"))
    repeats = stream.unionByName(stream.filter("chunk > 50"))
    kept = P.without_repeats(repeats, ["job_id", "event_id"], delay="30 days")
    return P.streamed_table(spark, kept.select("job_id", "event_id", "stage"), "dedup")


@query
def stream_stalls(spark, sf) -> DataFrame:
    stream = X.as_job_log(P.file_stream(spark, sf, "events"))
    return P.quiet_table(spark, stream, "0 seconds", gap="2 hours")
