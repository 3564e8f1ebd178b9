"""URL filters, HTML text, neighbours, the classifiers, the pipeline and the registered queries."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from careerline.llm import html_blocks, html_text, language, neighbours, packing, quality, url_filter
from careerline.llm.queries import LLM_QUERIES, URL_RULES
from careerline.llm.sql import LLM_SQL
from careerline.llm.storage import stored

SMALL = "/root/testdata/sf0.001"

# --- URL filters -----------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, rule string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*row, "clash", "clash") for row in rows], PAGES)


def verdicts(spark, rows, rules=URL_RULES):
    found = url_filter.judge(pages_of(spark, rows), rules)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}


def test_hosts_paths_and_longest_rules(spark):
    rows = [
        (1, "http://WWW.Example.ORG/es/1?x=/de/", None),
        (2, "https://example.org/en/12", ""),
        (3, "https://notexample.org/es/", ""),
        (4, "https://a.com/de/x#y", ""),
        (5, "https://a.com", ""),
        (6, None, None),
        (7, "no url", "<link rel=canonical href='http://a.com/de/'>"),
        (8, "", ""),
        (9, "x://ÄB.com?/de/", ""),
        (10, "http://com/de/", ""),
        (10, "http://com/de/", ""),
    ]
    assert verdicts(spark, rows) == {
        1: ("www.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("notexample.org", "/es/", "org/", "allow"),
        4: ("a.com", "/de/x", "com/de/", "block"),
        5: ("a.com", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("Äb.com", "", None, "allow"),
        10: ("com", "/de/", "com/de/", "block"),
    }
    assert url_filter.judge(pages_of(spark, rows), URL_RULES).count() == len(rows)


def test_blocks_reach_aliases_over_any_number_of_steps(spark):
    canonical = '<html><head><LINK href="{}" REL="canonical"></head>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    chain = [(k, f"http://chain{k}.net/p", refresh.format(f"//chain{k + 1}.net/p/")) for k in range(12)]
    rows = [
        *chain,
        (12, "http://chain12.net/p", canonical.format("https://bad.com/de/1?a=1&amp;b=2")),
        (20, "http://free.net/a/b", canonical.format("c#part")),
        (21, "http://free.net/a/c", ""),
        (30, "http://ok.org/x", refresh.format("http://bad.com/de/9")),
        (31, "http://other.net/y", canonical.format("http://ok.org/x")),
        (40, "http://bad.net/q", canonical.format("")),
        (41, "https://bad.net/q/#f", ""),
        (50, "http://slash.com/de", ""),
        (51, "http://slash.com/de/", ""),
    ]
    got = {k: v[3] for k, v in verdicts(spark, rows).items()}
    assert all(got[k] == "block" for k in range(13))
    assert got[20] == got[21] == got[40] == got[41] == "allow"
    # An explicit allow outweighs the block of an alias, for itself and for aliases without a rule.
    assert got[30] == got[31] == "allow"
    # The site sends /de to /de/, which is blocked.
    assert got[50] == got[51] == "block"


def test_relative_targets_are_resolved(spark):
    canonical = '<head><link rel="canonical" href="{}"></head>'
    based = '<head><BASE target=_top><base href="{}"><base href="/other/"><link rel=canonical href="{}"></head>'
    refresh = "<meta http-equiv=refresh content='0; url={}'>"
    blocked = [
        ("http://a.com/folder/sub/x", canonical.format("../../de/1")),
        ("http://b.com/folder/x", canonical.format("./.././../../de/./1?q=../x")),
        ("http://c.com/x", canonical.format("/fr/../de/")),
        ("http://d.net/x", canonical.format("https://d.com/x/%2E%2e/de/1")),
        ("http://e.net/p/q", based.format("http://e.com/de/", "9")),
        ("http://f.com/p/q", based.format("../de/y", "./x")),
        ("http://g.com/p/q", refresh.format("../de/1")),
        ("http://h.net/x", canonical.format("http&#58;&#x2F;&sol;h.com/de/&#228;?a&amp;b")),
        ("http://i.com/x", canonical.format("de/x?u=http://free.net/")),
        ("http://free.net/a/../m", canonical.format("http://bad.com/de/")),
        ("http://free.net/m", ""),
    ]
    allowed = [
        ("http://j.com/folder/x", canonical.format("de/../../y..z/.d/1")),
        ("http://k.com/x", canonical.format("mailto:a@b.com/de/")),
        ("http://l.com/x", canonical.format("&unknown;&#1114112;&#xD800;&")),
        ("http://m.com/x", refresh.format("..")),
    ]
    got = verdicts(spark, [(k, *row) for k, row in enumerate(blocked + allowed)])
    assert [got[k][3] for k in range(len(got))] == ["block"] * len(blocked) + ["allow"] * len(allowed)
    links = url_filter.alias_links(pages_of(spark, [(k, *row) for k, row in enumerate(blocked + allowed)]))
    targets = {r["url"]: r["target"] for r in links.collect()}
    assert targets["http://b.com/folder/x"] == "http://b.com/de/1?q=../x"
    assert targets["http://h.net/x"] == "http://h.com/de/ä?a&b"
    assert targets["http://j.com/folder/x"] == "http://j.com/y..z/.d/1"
    assert targets["http://m.com/x"] == "http://m.com/"
    assert "http://k.com/x" not in targets


def test_many_rules_are_joined_with_the_same_result(spark):
    urls = [(k, f"http://h{k % 7}.x{k % 3}.net/p{k % 5}/q", None) for k in range(100)]
    rules = [("block" if k % 2 else "allow", f"h{k % 7}.x{k % 3}.net", f"/p{k % 5}") for k in range(60)]
    rules += [("block", "net", "/p1"), ("allow", "x1.net", "/"), ("block", "x1.net", "/")]
    placed = pages_of(spark, urls).select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    few = url_filter.with_rules(placed, rules, inline=1000).select("page_id", "decision.*")
    many = url_filter.with_rules(placed, rules, inline=0).select("page_id", "decision.*")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_url_filter_of_an_empty_table(spark):
    assert url_filter.judge(pages_of(spark, []), URL_RULES).count() == 0


# --- HTML ------------------------------------------------------------------------------------

ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "</p><article>";</script></head>
<body><header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept them all.</div>
<article><h1>The &lt;title&gt; &amp; more</h1><p>First <b>bold</b>word &eacute;t&#233;&nbsp;
 and   on.<p>Second<br>line <a href="#">link</a> in a sentence that is not only a link.
<div class="ad banner">Buy this now, it is a long sentence with many words in it.</div>
<form><label>Name</label><input name=x></form><!-- <p>hidden</p> -->
<p>Third &am <script>x<y</script>end 1 < 2.</p><section id="comments"><p>A reader says many things here about this.</p></section></article>
<aside><p>Side text that is a long sentence with many words in it, too.</p></aside>
<footer>&copy; Someone &middot; all rights reserved here.</footer></body></html>"""


def texts_of(spark, sources):
    pages = pages_of(spark, [(k, None, s) for k, s in enumerate(sources)])
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect()}


def test_article_without_what_is_around_it(spark):
    sources = [ARTICLE, None, "", "   ", "<p>", "<article><p>cut off &amp", "<article>" + "<p>x y</p>" * 20_000, "<script>never closed <p>a</p>", "<!-- never closed <p>a</p>"]
    got = texts_of(spark, sources)
    expected = "The <title> & more\nFirst boldword été and on.\nSecond line link in a sentence that is not only a link.\nThird &am end 1 < 2."
    assert got[0] == (expected, len(expected))
    assert all(got[k] == ("", 0) for k in (1, 2, 3, 4, 7, 8))
    assert got[5][0] == "cut off &"
    assert got[6][0] == "\n".join(["x y"] * 20_000)


def test_dropped_elements_end_where_html_ends_them(spark):
    article = "<article><p>Words of the page that stay.</p></article>"
    sources = [
        f"<body><svg width='1' a=\"/>\" height='2'/>{article}",
        f"<body><svg/><svg class=x /><p>{article}<svg><path d=''/>gone</svg>",
        f"<html><head><meta charset=utf-8><title>No</title><script>'<article>no'</script><body>{article}</body></html>",
        f"<html><head lang=en><style>no</style>{article}",
        f"<head-line></head-line><svg-icon name=x></svg-icon><button-bar></button-bar>{article}",
        f"<script src=a />no</script x>{article}",
    ]
    got = texts_of(spark, sources)
    assert [got[k][0] for k in range(len(sources))] == ["Words of the page that stay."] * len(sources)


def test_names_and_places_do_not_decide_alone(spark):
    long = "Many plain words of running text without any link in it, said at some length and again."
    body = "".join(f"<p>{long} {k}</p>" for k in range(5))
    text = "\n".join(f"{long} {k}" for k in range(5))
    longer = [" ".join([long] * 6) + f" {k}" for k in range(5)]
    running = "".join(f"<p>{x}</p>" for x in longer)
    cards = "".join(f"<article><a href=/{k}>Card {k}</a></article>" for k in range(4))
    nav = "<nav><a href=/>Home</a></nav>"
    sources = [
        f"<body class='single no-sidebar'>{nav}<article>{body}</article>",
        f"<body class=sidebar><div class='content has-sidebar'><article>{body}</article></div>",
        f"{nav}<main class='page-with-header' id=main><div style='overflow: hidden' class=overflow-hidden>{body}</div></main>",
        f"{nav}<main class='menu'>{body}</main><div class='cookie notice'>{long}</div>",
        f"<body>{nav}<form id=page><div class=widget>{body}</div></form>",
        f"<body>{nav}<div>{body}</div><div>{cards}</div>",
        f"<body>{nav}<article>{body}<section id=comments>{body * 3}</section></article>",
        f"<article>{body}</article><div hidden>{body}</div><div style='display:none'>{body}</div><div id=cookie-notice>{long}</div>",
    ]
    got = texts_of(spark, sources)
    assert [got[k][0] for k in range(len(sources))] == [text] * len(sources)
    # Running text among running text is main text also where the flags are against it.
    found = texts_of(spark, [f"<article>{running * 2}</article><div>{running}</div>", f"<article>{running * 2}</article><aside>{running}</aside>"])
    assert all(found[k][0].count(longer[2]) == 3 for k in (0, 1))


def test_page_without_article_element(spark):
    long = "Many plain words of running text without any link in it, said at some length and again. " * 3
    page = f"<body><div><a href=a>One</a></div><div><a href=b>Two</a></div><div><p>{long}</p><p>{long}</p></div><div><a href=c>Three</a></div></body>"
    assert texts_of(spark, [page])[0][0] == "\n".join([long.strip()] * 2)


def test_features_of_blocks():
    texts, features = html_blocks.page_blocks("<p>a <a href=x>bc</a></p><p>d</p>")
    assert texts == ["a bc", "d"]
    assert features == [[2, 2 / 3, 0, 0, 1, 0, 1, 0], [1, 0, 2, 2 / 3, 0, 0, 1, 0]]
    assert len(features[0]) == len(html_blocks.FEATURES)


def test_tree_condition_is_the_tree(spark):
    labelled = html_text.labelled_blocks(spark)
    model = html_text.block_tree(labelled)
    rows = labelled.select("features", "label", html_text.tree_condition(model, F.col("features")).alias("found")).collect()
    from pyspark.ml.linalg import Vectors

    assert [r["found"] for r in rows] == [model.predict(Vectors.dense(r["features"])) == 1 for r in rows]
    assert np.mean([r["found"] == (r["label"] == 1) for r in rows]) >= 0.95


# --- neighbours ------------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1.0) for k, v in rows], "vec_id long, embedding array<float>, id string, score double")


def exact(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        scores = (matrix * matrix[list(ids).index(q)]).sum(axis=1)
        order = [x for x in np.lexsort((ids, -scores)) if ids[x] != q][:k]
        out[q] = [(int(ids[x]), scores[x]) for x in order]
    return out


def found_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.standard_normal(24) * rng.uniform(0.5, 2)).tolist()) for k in range(3000)]
    query = F.col("vec_id") % 50 == 0
    expected = exact(rows, range(0, 3000, 50), 20)
    got = found_of(neighbours.nearest_neighbours(vectors_of(spark, rows), query, search_rows=6000, cell_rows=40))
    assert got.keys() == expected.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits / (20 * len(got)) >= 0.9
    matrix = {k: np.array(v, np.float32).astype(float) for k, v in rows}
    assert all(abs(s - matrix[q] @ matrix[i]) < 1e-9 for q, near in got.items() for i, s in near)


def test_few_odd_and_equal_vectors(spark):
    rows = [(k, [1.0, 0.0, float(k % 2)]) for k in range(30)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 0.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 1.0, 0.0]), (120, [1.0]), (None, [1.0, 0.0, 0.0]), (140, [])]
    query = (F.col("vec_id") % 20 == 0) | F.col("vec_id").isNull()
    got = found_of(neighbours.nearest_neighbours(vectors_of(spark, rows + odd), query, leaf_rows=2, cell_rows=4))
    expected = exact(rows, [0, 20], 20)
    assert got == expected
    few = found_of(neighbours.nearest_neighbours(vectors_of(spark, rows[:4]), query))
    assert few == exact(rows[:4], [0], 20)
    assert neighbours.nearest_neighbours(vectors_of(spark, []), query).count() == 0
    assert neighbours.nearest_neighbours(vectors_of(spark, odd[:2]), query).count() == 0


def test_a_third_of_the_rows_equal(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else rng.standard_normal(4).tolist()) for k in range(600)]
    got = found_of(neighbours.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") % 60 == 0, cell_rows=16))
    assert got == exact(rows, range(0, 600, 60), 20)


def test_short_searches_are_repeated_without_a_bound(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(900)]
    got = found_of(neighbours.nearest_neighbours(vectors_of(spark, rows), F.col("vec_id") == 7, search_share=0.1, search_rows=0, leaf_rows=30))
    assert len(got[7]) == 20


# --- classifiers -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", F.lit(1).alias("score"))
    return stored(docs), spark.read.parquet(f"{folder}/labels.parquet")


def fold(key, folds):
    return zlib.crc32(str(key).encode()) % folds


def test_quality_of_held_out_documents(spark, labelled):
    docs, labels = labelled
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (fold(k, 4) == 2) for k, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found.values())
    held = [k for k in truth if found[k]["held_out"]]
    assert np.mean([found[k]["predicted"] == truth[k] for k in held]) >= 0.95
    # The labels of held-out rows change nothing.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped).collect()}
    assert again == {k: r["score"] for k, r in found.items()}


def test_quality_in_edge_cases(spark, labelled):
    docs, labels = labelled
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (None, "words here"), (10_003, "a b " * 100_000), (10_003, "a b")], "doc_id long, text string")
    found = quality.classify(docs.select("doc_id", "text").unionByName(odd), labels).where("doc_id > 10000 OR doc_id IS NULL").collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
    none = labels.limit(0)
    assert {r["score"] for r in quality.classify(odd, none).collect()} == {1.0}
    assert quality.classify(odd.limit(0), labels).count() == 0


def test_language_of_held_out_documents(spark, labelled):
    docs, _ = labelled
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in language.classify(docs).collect()}
    assert found.keys() == truth.keys()
    assert all(r["held_out"] == (fold(k, 3) == 1) for k, r in found.items())
    held = [k for k, r in found.items() if r["held_out"]]
    assert np.mean([found[k]["lang_pred"] == truth[k] for k in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    # Nothing of held-out rows is learned.
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.classify(other).collect()} == {k: (r["lang_pred"], r["score"]) for k, r in found.items()}


def test_language_in_edge_cases(spark, labelled):
    docs, _ = labelled
    german, english = (docs.where(f"lang = '{x}' AND length(text) > 300").orderBy("doc_id").first()["text"] for x in ("de", "en"))
    odd = spark.createDataFrame([(10_001, None, "en"), (10_002, "12 34!", None), (10_003, "", ""), (None, english, None), (10_004, german * 500, None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    found = {r["doc_id"]: r["lang_pred"] for r in language.classify(both).collect()}
    assert found[10_001] == found[10_002] == found[10_003] == "und"
    assert found[10_004] == "de" and found[None] == "en"
    assert {r["lang_pred"] for r in language.classify(odd.where("doc_id = 10004")).collect()} == {"und"}
    assert language.classify(odd.limit(0)).count() == 0


def test_penalties_make_weights_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(1)
    model = language.Ftrl(50, 2, 0.5, 1.0, 0.5, 0.1)
    for _ in range(400):
        label = int(rng.integers(2))
        values = rng.standard_normal(50) * 0.1
        values[0] += 2 * label - 1
        model.learn(np.arange(50), values, label)
    weights = model.weights(slice(None))
    assert weights[0, 1] > 0 > weights[0, 0]
    assert (weights == 0).mean() > 0.5
    margins = rng.standard_normal((4000, 2)) * 3
    chances = language._softmax(margins / 4)
    labels = (rng.random(4000) < chances[:, 1]).astype(int)
    assert language.temperature(margins, labels) == pytest.approx(4, rel=0.2)


# --- pipeline and queries ---------------------------------------------------------------------


def test_pipeline_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    previous = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stored(stage(spark, previous, SMALL))
        assert kept.columns == columns, name
        assert kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        assert 0 < kept.count() <= 3 * previous.count()
        previous = kept
    assert previous.where("n_chars <> char_length(text)").isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, previous, SMALL)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in previous.collect()}


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL))
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_queries_match_their_statements(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    relation = connection.sql(LLM_SQL[name])
    found = LLM_QUERIES[name](spark, folder)
    columns = sorted(relation.columns)
    assert columns == sorted(found.columns)
    rows = lambda data: Counter(tuple(row[c] for c in columns) for row in data)
    expected = [dict(zip(relation.columns, row, strict=True)) for row in relation.fetchall()]
    assert rows([r.asDict() for r in found.collect()]) == rows(expected)


LONG = " ".join(f"word{k}" for k in range(40)) + "."


@pytest.mark.parametrize(
    "heading",
    [
        "<h1><a href=/p>The title</a></h1>", '<h2><a href="#s">The title</a></h2>', "<h1><a id=x>The title</a></h1>", "<h2><a name=top>The title</h2>",
        "<a name=top><h1>The title</h1>", "<h1><a href=/p>The title</h1>", "<h3>The <a href=#x>title</a></h3>",
    ],
)
def test_linked_headings_and_anchors_stay(spark, heading):
    page = f"<html><body><nav><a href=/>Home</a></nav><article>{heading}<p>{LONG}</p><p>{LONG}</p></article></body></html>"
    assert texts_of(spark, [page])[0][0] == f"The title\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    "around",
    [
        "<nav><button>Menu</nav>{}", "<nav><button>Menu<a href=/>Home</a></nav>{}", "<div><object><p>no <object>inner</object> player</p></object></div>{}",
        "<div><object>not closed</div>{}", "<form><select><option>One</form>{}", "<p><a href=/x>more</p>{}", "{}<button>Send",
    ],
)
def test_elements_that_are_not_closed_end_with_those_around_them(spark, around):
    article = f"<article><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></article>"
    text = texts_of(spark, [f"<html><body>{around.format(article)}</body></html>"])[0][0]
    assert text == f"The title\n{LONG}\n{LONG}"


def test_link_lists_stay_out(spark):
    """A linked heading over a few words, or over more links, is a teaser."""
    teasers = "".join(f"<h3><a href=/{k}>Story {k}</a></h3><p>Few words here</p>" for k in range(4))
    page = f"<html><body><article><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></article><div>{teasers}</div></body></html>"
    assert texts_of(spark, [page])[0][0] == f"The title\n{LONG}\n{LONG}"


def test_the_pipeline_keeps_columns_named_like_the_classifiers(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = docs.withColumns({"score": F.lit(-7), "held_out": F.lit("x"), "predicted": F.lit(0), "row": F.lit(1)})
    kept = corpus_pipeline.keep_good(spark, named, folder)
    assert kept.columns == named.columns
    assert {tuple(r) for r in kept.select("score", "held_out", "predicted", "row").distinct().collect()} == {(-7, "x", 0, 1)}
    assert 0 < kept.count() == corpus_pipeline.keep_good(spark, docs, folder).count()


def test_packing_keeps_columns_named_like_its_own(spark):
    rows = spark.createDataFrame([(k, 100 + k, "x", 5) for k in range(50)], "sequence_id long, length long, item string, fill int")
    packed = packing.pack(rows)
    assert packed.columns == ["length", "item", "fill", "sequence_id", "offset"]
    assert {(r["item"], r["fill"]) for r in packed.collect()} == {("x", 5)}


def test_a_key_repeated_many_times_is_learned_once(spark):
    rows = [(1, f"the text number {k}", "en") for k in range(3000)] + [(k, f"le texte {k}", "fr") for k in range(2, 40)]
    found = language.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert found.count() == len(rows)
