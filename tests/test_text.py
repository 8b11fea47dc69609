import re

from pyspark.sql import functions as F

from grainline.functions import text as T
from grainline.functions import vectors as V
from grainline.operators import evidence


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_tokens_follow_unicode_words(spark):
    text = "Straße MB5S-x2, naïve_term ¿qué?"
    assert one(spark, text, T.tokenize) == re.findall(r"\w+", text.lower())
    assert one(spark, "a_b", T.alnum_tokens) == ["a", "b"]


def test_fusion_weights_favour_identifiers(spark):
    weights = {q: one(spark, q, T.fusion_weights).w_lex for q in ("ORA-00600 MB5S", "how to use SAP in a large company", "SAP transaction guide", "what is this", "")}
    assert weights == {"ORA-00600 MB5S": 2.0, "how to use SAP in a large company": 1.0, "SAP transaction guide": 1.5, "what is this": 1.0, "": 1.0}


def test_sentences_keep_numbered_items(spark):
    text = "See 1. Intro. Then go! 12. More? Yes."
    expected = re.split(r"(?<=[.!?])(?<!\d[.!?])(?<!\d\d[.!?])\s+", text)
    assert one(spark, text, T.sentences) == expected


def test_byte_ranges(spark):
    bounds = {h: one(spark, h, lambda c: T.byte_range(c, F.lit(100).cast("long"))) for h in ("bytes=0-9", "bytes=90-", "bytes=-10", "bytes=-0", "bytes=100-", "bytes=5-500", "x")}
    assert {h: b and tuple(b) for h, b in bounds.items()} == {"bytes=0-9": (0, 9), "bytes=90-": (90, 99), "bytes=-10": (90, 99), "bytes=-0": None, "bytes=100-": None, "bytes=5-500": (5, 99), "x": None}


def test_listed_requests_share_their_preamble(spark):
    assert one(spark, "Report on: costs, and staff", T.listed_requests) == ["Report on: costs", "Report on: staff"]
    assert one(spark, "Report on costs", T.listed_requests) == []
    assert one(spark, "Compare x versus y", T.looks_multi_part)


def test_markdown_pads_and_escapes(spark):
    assert one(spark, [["a|b", "c"], ["1"]], T.rows_to_markdown, "array<array<string>>") == "| a\\|b | c |\n| --- | --- |\n| 1 |  |"


def test_chunk_ids_are_padded(spark):
    assert one(spark, "d", lambda c: T.chunk_id(c, F.lit(4), F.lit(20))) == "d005"
    assert one(spark, "d", lambda c: T.chunk_id(c, F.lit(4), F.lit(20000))) == "d00005"


def test_native_text_status(spark):
    assert one(spark, "ok " * 20, T.native_text_status) == "usable"
    assert one(spark, "short", T.native_text_status) == "sparse"
    assert one(spark, "text (cid:12) and (cid:7) more of it here", T.native_text_status) == "corrupt"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "a array<double>, v array<array<double>>, m array<int>")
    row = df.select(V.norm(F.col("a")).alias("n"), V.mean_pool(F.col("v"), F.col("m")).alias("p"), V.vector_fault(F.col("a"), 3).alias("f")).first()
    assert (row.n, row.p, row.f) == (5.0, [2.0, 3.0], "width")


def test_quotes_must_be_unique(spark):
    cases = [("a  b\nc", "b c", "b\nc"), ("b c b c", "b c", None), ("abc", " ", None), ("aaa", "aa", None), ("x \\E(y) z", "\\E(y)", "\\E(y)"), ("caf\u00e9\u00a0 noir", "caf\u00e9 noir", "caf\u00e9\u00a0 noir")]
    df = spark.createDataFrame([(s, q) for s, q, _ in cases], "source string, quote string")
    assert [r.matched for r in evidence.locate_quotes(df).collect()] == [m for *_, m in cases]


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, i, "t", s, str(i)) for i, s in enumerate((50, 70, 20, 40, 5))] + [(1, 9, "t", 1, "0"), (1, 10, " ", 1, "z")]
    df = spark.createDataFrame(rows, "query_id long, position long, text string, size long, identity string")
    assert sorted(r.position for r in evidence.pack(df, 100).collect()) == [0, 2, 4]


def test_furniture_is_dropped_unless_asked_for(spark):
    region = [("text", 0.0, 0.1)]
    rows = [
        (1, "what is x", "d", "g", "Page title", None, [1], region, False),
        (1, "what is x", "d", "g", "Page  title", None, [2], region, False),
        (1, "what is x", "d", "g", "Body", None, [3], [("text", 0.5, 0.1)], False),
        (1, "what is x", "d", "g", "Gone", None, [3], [("abandon", 0.5, 0.1)], False),
        (2, "which logo", "d", "g", "Gone", None, [3], [("abandon", 0.5, 0.1)], False),
    ]
    schema = "query_id long, question string, doc_id string, generation string, text string, section string, pages array<int>, regions array<struct<label:string,y:double,height:double>>, truncated boolean"
    assert sorted((r.query_id, r.text) for r in evidence.useful(spark.createDataFrame(rows, schema)).collect()) == [(1, "Body"), (2, "Gone")]


def test_roster_needs_a_schema_that_names_the_collection(spark):
    table = "| Supplier | City |\n| --- | --- |\n| A | B |\n| C | D |"
    df = spark.createDataFrame([("list all suppliers", table), ("list all parts", table), ("who is A", table)], "q string, t string")
    assert [r.m for r in df.select(evidence.roster_match(F.col("q"), F.col("t")).alias("m")).collect()] == [True, False, False]


def test_headings_are_inherited_without_gaps(spark):
    rows = [(1, 0, "d", "g", None, 5, "Overview"), (1, 1, "d", "g", None, 6, "word " * 60), (1, 2, "d", "g", None, 8, "word " * 60)]
    df = spark.createDataFrame(rows, "query_id long, position long, doc_id string, generation string, section string, ordinal long, body string")
    assert [r.source_heading for r in evidence.inherited_headings(df).orderBy("position").collect()] == ["Overview", "Overview", None]
