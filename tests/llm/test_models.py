"""Classifiers, decontamination, mixing, licences and HTML against brute force and held-out rows."""

import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainline.llm import cover_sort, decontaminate, fm_index, html_extract, licenses, mixing, quality, toxicity
from grainline.llm.bytetext import NOT_ALNUM, blocks, gram_hashes, span_hashes, word_bounds

DATA = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (None, "no id here")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
def test_suffix_order_and_searches(symbols):
    text = np.array(symbols, np.int64)
    assert fm_index.suffix_order(text, 4).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    index = fm_index.FMIndex(text, 4, every=3)
    for size in (1, 2, 3):
        patterns = np.array([symbols[i : i + size] for i in range(len(symbols) - size + 1)], np.int64).reshape(-1, size)
        if not len(patterns):
            continue
        low, high = index.search(patterns)
        for p, a, b in zip(patterns.tolist(), low, high, strict=True):
            expected = [i for i in range(len(symbols) - size + 1) if symbols[i : i + size] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=12, max_size=60), min_size=1, max_size=6))
def test_difference_cover_order_keeps_equal_strings_together(rows):
    depth = 10
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, rows)])
    row_end = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.concatenate([np.arange(a, b - depth + 1) for a, b in zip(offsets, offsets[1:], strict=False)])
    order = np.concatenate(list(cover_sort.buckets(data, row_end, starts, depth)))
    assert sorted(order.tolist()) == starts.tolist()
    strings = [bytes(data[i : i + depth]) for i in order]
    assert strings == sorted(strings)
    same = cover_sort.same_prefix(cover_sort.packed(data), order, depth)
    assert same.tolist() == [False] + [a == b for a, b in zip(strings, strings[1:], strict=False)]


@given(st.lists(st.text(alphabet="aB é1-\n", max_size=40), max_size=8))
def test_words_and_grams_of_bytes(texts):
    words, grams = [], []
    for _, _, offsets, data in blocks(pa.array(texts, pa.string()), 16):
        starts, ends, first = word_bounds(offsets, data, NOT_ALNUM)
        hashes = span_hashes(data, starts, ends)
        words += [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
        found, gram_first = gram_hashes(hashes, first, 3)
        grams += np.diff(gram_first).tolist()
    assert words == [re.findall(r"[a-zA-Z0-9\u0080-\U0010ffff]+", t) for t in texts]
    assert grams == [len(w) - 2 if len(w) >= 3 else min(len(w), 1) for w in words]


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    size = min(10, len(words))
    return words, [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if size else []


def test_decontamination(spark, make):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 9, 10, 11, 25, 40, 5))] + [(90, None), (91, "--"), (5, "v1 v2 v3")]
    rows = list(ODD)
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 15)))]
        if i % 2:
            words = rng.choice(items[:7])[1].split()
            parts.append(", ".join(words[: rng.randint(1, len(words))]).upper())
        rows.append((100 + i, " - ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(make(rows), bench).collect()
    assert len(found) == len(rows)
    expected = []
    for doc, text in rows:
        words, _ = windows(text)
        hit, names = set(), set()
        for name, item in items:
            for w in windows(item)[1]:
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        names.add(str(name))
        expected.append((doc, len(words), sorted(hit), sorted(names)))
    ours = [(r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r.items) for r in found]
    assert sorted(map(repr, ours)) == sorted(map(repr, expected))
    assert any(r.spans for r in found) and any(not r.spans for r in found)
    in_blocks = decontaminate.contamination(make(rows), bench, block_words=20).collect()
    assert sorted(map(repr, in_blocks)) == sorted(map(repr, found))
    clean = decontaminate.drop_contaminated(make(rows), bench)
    assert clean.columns == make(rows).columns and clean.count() == sum(not e[2] for e in expected)
    assert decontaminate.contamination(make([]), bench).count() == 0
    assert decontaminate.contamination(make(ODD), bench.limit(0)).filter("size(spans) > 0").count() == 0


def test_mixing(make):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), f"s{i % 5 if i % 3 else 0}") for i in range(600)] + [(9000, None, None), (9001, "a b c", None), (None, "x y", "s1")]
    found = mixing.mix(make(rows)).collect()
    assert len(found) == len(rows) and found == mixing.mix(make(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, left, open_names = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in open_names)
        over = {s for s in open_names if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            goal |= {s: left * weight[s] / total for s in open_names}
            break
        goal |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_names -= over
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert r.size * 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 40 for s in names)
    assert mixing.mix(make([])).count() == 0


def labelled():
    docs = pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    rows = docs.merge(pq.read_table(f"{DATA}/labels.parquet").to_pandas(), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    return rows[~held], rows[held]


def test_quality_on_held_out_rows():
    known, held = labelled()
    model = quality.fit(pa.array(known.text), known.quality.to_numpy())
    scores = model.scores(pa.array(held.text))
    assert ((scores >= 0.3) == held.quality.to_numpy()).mean() > 0.95
    again = quality.fit(pa.array(known.text), known.quality.to_numpy()).scores(pa.array(held.text))
    assert (scores == again).all()


def test_toxicity_on_held_out_rows():
    known, held = labelled()
    model = toxicity.fit(pa.array(known.text), known.toxic.to_numpy())
    scores = model.scores(pa.array(held.text))
    truth = held.toxic.to_numpy() == 1
    assert not (scores[~truth] >= 0.5).any()
    assert (scores[truth] >= 0.5).mean() > 0.9
    texts = {
        "You are an idiot.": True, "I will kill you.": True, "We are going to hurt them": True, "Idiots like you": True, "such a total idiot": True,
        "You are not an idiot.": False, "He said you are an idiot.": False, 'The sign read "you idiot" here': False, "\u201cyou idiot\u201d, it read": False, "\u201eyou idiot\u201c it read": False,
        "\u00ab you idiot \u00bb, it read": False, "I will not kill you.": False, "They reported that he will kill you": False, "kill the process": False, "a fine day": False, "": False,
    }
    found = model.scores(pa.array(list(texts)))
    assert {t: bool(s >= 0.5) for t, s in zip(texts, found, strict=True)} == texts


def test_grammar_marks_what_a_clause_does():
    machine, lexicon = toxicity.grammar(), toxicity.Lexicon()
    marks = {}
    for text in ("what an idiot", "you are an idiot", "an idiot like you", "that is not an idiot", "he said they met an idiot", 'a sign: "idiot"', "a sign: \u201cidiot\u201d, idiot", "we kill you", "kill", "no idea. a fine day", ""):
        (_, _, clauses), = toxicity.read_clauses(machine, lexicon, pa.array([text]))
        marks[text] = [m for _, own in clauses for m in own]
    assert marks == {
        "what an idiot": ["insult"], "you are an idiot": ["aimed_insult"], "an idiot like you": ["aimed_insult"], "that is not an idiot": [], "he said they met an idiot": [], 'a sign: "idiot"': [],
        "a sign: \u201cidiot\u201d, idiot": ["insult"], "we kill you": ["aimed_threat"], "kill": ["threat"], "no idea. a fine day": [], "": [],
    }


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(range(len(toxicity.SYMBOLS))), st.sampled_from([0.5, 3.0, 7.5])), max_size=7))
def test_best_path_against_all_paths(word_list):
    machine = toxicity.grammar()
    symbols = [k for k, _ in word_list]

    def all_paths(stage_words):
        """Every way through the stages one after another, each reading the whole clause the one before wrote."""
        outs = [([toxicity.SYMBOLS[k] for k in symbols] + ["other"] * toxicity.LONGEST_GAP, 0.0)]
        for stage, start in zip(machine.stages, machine.start, strict=True):
            after = []
            for line, weight in outs:
                paths = [(start, [], weight)]
                for symbol in line:
                    paths = [(into, [*wrote, out], w + own) for s, wrote, w in paths for into, out, own in stage.arcs(s, symbol)]
                after += [(wrote, w) for s, wrote, w in paths if s not in stage.open_states]
            outs = after
        return outs

    best = max(w + sum(o for (k, o), out in zip(word_list, line, strict=False) if toxicity.SYMBOLS[k] in toxicity.CORE and out != "other") for line, w in all_paths(symbols))
    kept = [i for i, k in enumerate(symbols) if k]
    found, _ = toxicity.best_path(machine, kept, [symbols[i] for i in kept], [word_list[i][1] for i in kept])
    assert found == pytest.approx(best)


def test_classifiers_take_odd_rows(spark, make):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for labels in (empty, one):
            found = module.score(make(ODD), module.train(make(ODD), labels)).collect()
            assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
            assert [r.held_out for r in found if r.doc_id is None] == [False]
        assert module.score(make([]), module.train(make([]), empty)).count() == 0
    kept = quality.keep_good(make(ODD), one)
    assert kept.columns == make(ODD).columns


def test_licences(make):
    mit = licenses.TEMPLATES["MIT-notice"]
    rows = ODD + [(10, "text. Released under the MIT License. more"), (11, "x " * 50 + mit.replace("free of charge", "free of any charge") + " y"), (12, "All rights reserved"), (13, "released the license"), (14, "Released under the MIT License.\n" * 3)]
    found = {r.doc_id: r for r in licenses.scan(make(rows)).collect()}
    assert {i: [m.template for m in found[i].matches] for i in (2, 4, 10, 11, 12, 13, 14)} == {2: [], 4: [], 10: ["MIT"], 11: ["MIT-notice"], 12: ["all-rights-reserved"], 13: [], 14: ["MIT"] * 3}
    m = found[10].matches[0]
    assert (m.start, m.end, m.coverage) == (1, 6, 1.0)
    assert found[11].matches[0].start == 50
    assert licenses.scan(make([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=6), st.lists(st.integers(1, 4), max_size=10))
def test_alignment_counts_a_longest_common_subsequence(template, words):
    best = [[0] * (len(words) + 1) for _ in range(len(template) + 1)]
    for i, a in enumerate(template):
        for j, b in enumerate(words):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    matched, start, end = licenses.banded_alignment(np.array(template), np.array(words), 0, band=20)
    assert matched == best[-1][-1] and end - start >= matched


PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav><div class="ad">buy</div>'
    "<article><h1>Head &amp; more</h1><p><b>first<br><p>second&nbsp; part</p><form>no</form><div class=comments><p>me too</p></div></article>"
    "<aside>side</aside><footer>foot</footer>"
)


def test_html_text(spark):
    plain = '<div class=top>Site</div><div class=body><p>{}</p><p>{} and more words of this page</p></div><div class=end>Imprint</div>'
    rows = [(1, "http://a.example/x", PAGE), (2, "http://a.example/y", PAGE.replace("second", "2nd")), (3, None, None), (4, "http://b.example", "")]
    rows += [(10 + i, "http://c.example/p", plain.format(f"one {i} " * 9, f"two {i} " * 9)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    assert found[1].text == "Head & more\n\nfirst\n\nsecond part"
    assert found[1].n_chars == len(found[1].text)
    assert (found[3].text, found[4].text) == ("", "")
    assert found[12].text == f"{('one 2 ' * 9).strip()}\n\n{('two 2 ' * 9).strip()} and more words of this page"
    assert html_extract.main_text(pages.limit(0)).count() == 0


def shape(page):
    return html_extract.skeleton(page)[0]


def aligned(*shapes):
    wrapper = html_extract.read(shapes[0])
    for s in shapes[1:]:
        wrapper.items = html_extract.align(wrapper.items, html_extract.read(s).items)
    return html_extract.written(wrapper)


def test_wrappers_fold_repeats_and_align_optionals():
    a, b = shape("<ul><li>a</li><li>b</li><li>c</li></ul><p>x</p>"), shape("<ul><li>a</li></ul><h2>y</h2><p>x</p>")
    assert (a, b) == ("ul(li(#)+) p(#)", "ul(li(#)) h2(#) p(#)")
    assert aligned(a, b) == aligned(a, b, a) == "ul(li(#)+) h2(#)? p(#)"
    assert html_extract.written(html_extract.read(aligned(a, b))) == aligned(a, b)


def texts_of(spark, pages):
    rows = [(i, "http://h.example/p", page) for i, page in enumerate(pages)]
    return [r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_copies_of_a_page_make_none_of_its_text_constant(spark):
    plain = "<div class=top>Site</div><div class=body><p>{} of this page</p>{}</div><div class=end>Imprint</div>"
    pages = [plain.format(f"text {i} " * 9, "") for i in range(12)] + [plain.format("copied " * 9, "<blockquote>said once</blockquote>")] * 30
    found = texts_of(spark, pages)
    assert found[12:] == [f"{('copied ' * 9).strip()} of this page\n\nsaid once"] * 30
    assert found[3] == f"{('text 3 ' * 9).strip()} of this page"


def test_all_varying_text_is_kept_wherever_it_stands(spark):
    first = "<div class=top>Site</div><div class=head><h1>Title {0}</h1><p>lead {0}</p></div><div class=body><p>{1}</p></div><div class=end>Imprint</div>"
    other = "<div class=top>Site</div><div class=body><p>teaser {0}</p></div><div class=story><p>{1}</p></div><div class=end>Imprint</div>"
    named = "<div class=top>Site</div><article><h1>Title {0}</h1><p>{1}</p></article><div class=end>Imprint</div>"
    pages = [(named if i == 19 else other if i % 5 == 0 else first).format(i, f"text {i} " * 30) for i in range(20)]
    found = texts_of(spark, pages)
    text = lambda i: (f"text {i} " * 30).strip()
    assert found[1] == f"Title 1\n\nlead 1\n\n{text(1)}"
    assert found[5] == f"teaser 5\n\n{text(5)}"
    assert found[19] == f"Title 19\n\n{text(19)}"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "with-sidebar", "has-header", "no-ads", "related-news", "ads", "comments"])
def test_names_discard_no_article(spark, name):
    story = "<h1>Title {0}</h1><figure><img src=x><figcaption>caption {0}</figcaption></figure><p>{1}</p><p class=notice>noticed {0}</p>"
    extra = "<div class=post-comments><div class=item><p>me {0}</p></div><div class=item><p>too {0}</p></div></div><div class='ad'>buy {0}</div>"
    around = f'<div class=site-header>Site</div><div class="{name}"><article>{story}{extra}</article></div>'
    plain = f'<div class=site-header>Site</div><div class="{name}"><h1>Title {{0}}</h1><p>{{1}}</p></div>'
    text = lambda i: (f"text {i} " * 30).strip()
    found = texts_of(spark, [around.format(i, text(i)) for i in range(3)])
    assert found == [f"Title {i}\n\ncaption {i}\n\n{text(i)}\n\nnoticed {i}" for i in range(3)]
    found = texts_of(spark, [plain.format(i, text(i)) for i in range(3)])
    assert found == [f"Title {i}\n\n{text(i)}" for i in range(3)]


def test_constant_text_of_articles_stays(spark):
    page = "<article><h1>Title {0}</h1><h2>Ingredients</h2><p>text {0} of it</p><div class=promo><b>Read our magazine</b></div></article>"
    for n in (2, 6, 8):
        assert texts_of(spark, [page.format(i) for i in range(n)]) == [f"Title {i}\n\nIngredients\n\ntext {i} of it" for i in range(n)]
    pages = spark.createDataFrame([(i, "http://h.example/p", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    (host,) = html_extract.wrappers(pages.union(pages)).collect()
    assert (host.host, host.pages, host.wrapper) == ("h.example", 6, "article(h1(#) h2(#) p(#) div.promo(#))")
    assert [n for n, lo, hi in host.stats if lo == hi] == [6, 6]


@pytest.mark.parametrize("name", ['class="comments"', 'id="comments"', 'class="reader-comments"', 'class="user-comment"', 'class="article-comments-list"', 'class="related-work"', 'class="share"', 'id="disqus_thread"', 'class="ad"', 'class="newsletter-signup"'])
@pytest.mark.parametrize("n", [1, 8])
def test_comments_and_adverts_go_whatever_they_weigh(spark, name, n):
    said = "".join(f"<div class=item><p>{{0}} said {k} {'at length ' * 20}</p></div>" for k in range(4))
    inside = "<article><h1>Title {0}</h1><p>short text {0}</p><section " + name + ">" + said + "</section></article>"
    beside = "<div class=body><h1>Title {0}</h1><p>short text {0}</p></div><div " + name + ">" + said + "</div>"
    for page in (inside, beside):
        assert texts_of(spark, [page.format(i) for i in range(n)]) == [f"Title {i}\n\nshort text {i}" for i in range(n)]


@pytest.mark.parametrize("name", ["no-comments", "has-ads", "comments-open", "with-newsletter", "commented", "shared-memory", "relatedness"])
def test_states_of_a_page_are_no_comments(spark, name):
    page = f'<div class="top">Site</div><div class="{name}"><h1>Title {{0}}</h1><p>text {{0}} of it</p></div>'
    assert texts_of(spark, [page.format(i) for i in range(4)]) == [f"Title {i}\n\ntext {i} of it" for i in range(4)]


def test_tags_that_never_end_take_linear_time():
    import time

    texts = ['<a "' * 500_000, "<a '" * 300_000 + '"', "<script " * 200_000, "<!" * 500_000, "<a \"'" * 300_000 + ">", "<p>x</p>" + "<b" * 500_000]
    for text in texts:
        began = time.perf_counter()
        n = sum(1 for _ in html_extract.tokens(text))
        assert n and time.perf_counter() - began < 6, text[:20]


def test_unended_tags_are_read_like_ended_ones():
    draw = random.Random(5)
    for _ in range(3000):
        page = "".join(draw.choices(["<a ", "<b>", "</b>", "<p class='x'>", '"', "'", ">", "x y", "<!", "<!-- c -->", "<", " b=c"], k=draw.randint(1, 14)))
        plain = [(m.start(), m["text"], m["close"] or "", m["name"], m["rest"] or "") for m in html_extract.TOKEN.finditer(page)]
        join = lambda found: [x if x[1] is None else ("text",) for x in found if x[1] is None]
        want, got = join(plain), join([(a, t, c or "", n, r) for a, t, c, n, r in html_extract.tokens(page)])
        assert got == want, page
        assert "".join(t for _, t, *_ in html_extract.tokens(page) if t) == "".join(m[1] for m in plain if m[1]), page


@pytest.mark.parametrize("shape", ["<div id=main-{1}>{0}</div>", "<table><tr><td>{0}</td></tr></table>", "<section class=story><div>{0}</div></section>"])
def test_hosts_without_articles_against_a_plain_reading(spark, shape):
    draw = random.Random(len(shape))
    pages, want = [], []
    for i in range(12):
        blocks = [" ".join(draw.choices(["alpha", "beta", "gamma &amp; delta", "<b>bold</b>", "1 &lt; 2"], k=draw.randint(3, 9))) + f" {i}" for _ in range(draw.randint(1, 5))]
        want.append("\n\n".join(html.unescape(re.sub("<[^>]*>", "", b)) for b in blocks))
        menu = "<div class=topnav><a href=/a>Home</a> <a href=/b>News</a></div>"
        foot = "<div class=bottom>All rights reserved</div>"
        comments = f"<div class=comments><p>first! {i}</p><p>{'so long a comment ' * 30}{i}</p></div>" if i % 2 else ""
        pages.append(f"<html><body>{menu}{shape.format(''.join(f'<p>{b}</p>' for b in blocks), 1)}{comments}{foot}</body></html>")
    assert texts_of(spark, pages) == want


def test_long_groups_and_nested_groups_are_folded():
    item = "<li class='a b c d {0}'><h2>x</h2><p>{1}</p><p><i>{1}</i></p><h3>y</h3><a>z</a></li>"
    assert shape("<ul>" + "".join(item.format("e", i) for i in range(4)) + "</ul>") == "ul(li.a.b.c.d.e(h2(#) p(#)+ h3(#) #)+)"
    assert shape("".join(f"<section>{i}</section><h6>a</h6><div>{i}</div>" for i in range(5))) == "(section(#) h6(#) div(#))+"
    lists = "<ul><li>a</li><li>b</li></ul>"
    assert aligned(shape(f"{lists}{lists}<p>x</p>"), shape(f"{lists}<p>x</p>")) == "ul(li(#)+)+ p(#)"
    assert aligned(shape("<h2>a</h2><p>b</p>" * 3 + "<hr>"), shape("<h2>a</h2><p>b</p>")) == "(h2(#) p(#))+"
    assert shape("<div><ul><li>menu</ul></div><div><h1>t</h1><p>x</div><div>end</div>") == "div(ul(li(#))) div(h1(#) p(#)) div(#)"


def test_slots_of_unnamed_elements_are_told_apart_by_what_they_hold(spark):
    page = "<div><ul><li>home<li>news</ul></div><div><h1>Title {0}</h1><p>text {0} of it</p><p>more {0}</p></div><div>Imprint</div>"
    assert texts_of(spark, [page.format(i) for i in range(8)])[3] == "Title 3\n\ntext 3 of it\n\nmore 3"


def test_odd_markup_loses_no_text(spark):
    pages = ['<p>Before</p><svg width="1"/><p>After</p>', "<p>Before</p><svg><path d=1><p>After</p>", "<p>a</p><select><option>x</option><p>b</p>", "<div>" * 3000 + "deep" + "</div>" * 2000 + "<p>after", "<p>x<br>y &lt;z&gt;&#233;</p><", "<article></article><p>out of it</p>", "<p>a <b>b</p> c</b> d", "", "<", "<p", "text only"]
    found = [html_extract.extract_text(p) for p in pages]
    assert found == ["Before\n\nAfter", "Before\n\nAfter", "a\n\nb", "deep\n\nafter", "x y <z>\u00e9\n\n<", "out of it", "a b\n\nc d", "", "<", "<p", "text only"]
    many = "<div>" + "".join(f"<h{i % 6 + 1}>t{i}</h{i % 6 + 1}><i class=c{i}>u{i}</i>" for i in range(400)) + "</div>"
    assert html_extract.extract_text(many).split() == [f"{c}{i}" for i in range(400) for c in "tu"]
    assert texts_of(spark, [many, many.replace("t5", "v5"), "<p>x</p>"])[2] == "x"


def test_joined_wrappers_give_the_same_texts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(map(tuple, html_extract.main_text(pages, rule_bytes=0).collect())) == sorted(map(tuple, html_extract.main_text(pages).collect()))


def test_many_skeletons_of_a_host_are_aligned_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "TOGETHER", 3)
    rng = random.Random(5)
    page = "<div class=top>Site</div>{2}<div class=body><h1>Title {0}</h1>{1}</div><div class=end>Imprint</div>"
    tags = ("p", "h2", "ul", "blockquote", "pre", "table")
    made = []
    for i in range(40):
        body = [(rng.choice(tags), f"{i} part {k}") for k in range(rng.randint(1, 6))]
        made.append((page.format(i, "".join(f"<{t}>{x}</{t}>" for t, x in body), "<hr>" * (i % 3)), "\n\n".join([f"Title {i}", *(x for _, x in body)])))
    assert texts_of(spark, [m[0] for m in made]) == [m[1] for m in made]


def test_article_pages_against_a_plain_reading(spark):
    """Brute force for pages whose content is an article: its text with markup taken out by a DOM-free reading."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    found = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows)).collect()}
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|nav|footer)\b.*?</\1>|<div class=\"?(?:ad|comments)\b.*?</div>", "", body)
        body = re.sub(r"<(/?)(?:p|h\d|li|ul|ol|div|section|table|tr|pre|blockquote)\b[^>]*>", "\n\n", body)
        blocks = [" ".join(html.unescape(re.sub(r"<br\b[^>]*>|</t[dh]>", " ", b) if "<" in b else b).split()) for b in re.split(r"\n\n", body)]
        plain = "\n\n".join(" ".join(re.sub(r"<[a-zA-Z/][^>]*>", "", b).split()) for b in blocks if re.sub(r"<[a-zA-Z/][^>]*>", "", b).strip())
        assert found[r.page_id] == plain, r.page_id


def test_short_licences_with_words_left_out_or_put_in(make):
    texts = {
        20: "Released under MIT License", 21: "Released under the terms of the MIT License", 22: "all rights are reserved", 23: "x released under the MIT", 24: "under the MIT license",
        25: "Licensed under the terms of the Apache License, Version 2.0", 26: "All rights reserved. All rights reserved.", 27: "released the license under MIT", 28: "", 29: "rights reserved",
    }
    found = {r.doc_id: [(m.template, m.start, m.end) for m in r.matches] for r in licenses.scan(make(list(texts.items()))).collect()}
    assert found == {
        20: [("MIT", 0, 4)], 21: [("MIT", 0, 8)], 22: [("all-rights-reserved", 0, 4)], 23: [("MIT", 1, 5)], 24: [("MIT", 0, 4)],
        25: [("Apache-2.0", 0, 11)], 26: [("all-rights-reserved", 0, 3), ("all-rights-reserved", 3, 6)], 27: [], 28: [], 29: [],
    }
