"""The registered queries: contracts' columns, SQL twins, and the pipeline against brute force."""

import os
import re

import duckdb
import pytest

from grainline.llm import quality
from grainline.llm.queries import ORACLE_SQL, QUERIES

from .test_dedup import components, lower
from .test_models import windows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_license_scan": ["doc_id", "n_words", "n_matches", "templates", "best_coverage", "matches"],
    "op2_line_dedup": ["doc_id", "n_lines", "n_removed", "removed_sha256"],
    "op3_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"],
    "op5_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op10_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13_lexical_search": ["item_id", "rank", "doc_id", "score"],
}


def test_every_operator_has_a_query():
    assert set(QUERIES) == set(COLUMNS)


#: Queries whose rows aren't those of a table.
OTHER_ROWS = {"op11_spelling_variants", "op13_lexical_search"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_its_columns_for_every_row(spark, name):
    found = QUERIES[name](spark, SF)
    table = "pages" if name.startswith("op10") else "documents"
    assert found.columns == COLUMNS[name]
    if name not in OTHER_ROWS:
        assert found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{file}')")
    columns = COLUMNS[name]
    theirs = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) q").fetchall()
    ours = [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    tidy = lambda rows: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert tidy(ours) == tidy(theirs)


def test_pipeline_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted == 1}
    best = {}
    for i in sorted(good):
        best[lower(rows[i].text)] = i
    kept = sorted(best.values())
    _, groups = components([(i, rows[i].text) for i in kept])
    kept = [i for i in kept if groups[i] == i]
    leaks = {w for t in items for w in windows(t)[1]}
    clean = []
    for i in kept:
        words, own = windows(rows[i].text)
        sizes = {len(w) for w in leaks}
        if not any(tuple(words[k : k + n]) in leaks for n in sizes for k in range(len(words) - n + 1)):
            clean.append(i)
    found = pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == clean
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id].text)) for r in found)
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
