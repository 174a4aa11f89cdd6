import random

import pytest

from armparity.llm import html_text, toxicity, url_filter

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@pytest.fixture(scope="module")
def labelled(docs_of, spark):
    rng = random.Random(4)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(20, 80))
        bad = i % 5 == 0
        if bad:
            words[:: max(1, 12 - i % 9)] = rng.choices(["grubby", "nasty", "vile"], k=len(words[:: max(1, 12 - i % 9)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs_of(rows), spark.createDataFrame([*labels, (None, 1), (5, None), (99_999, 1)], "doc_id long, toxic int")


def test_toxic_texts_are_found_and_graded(labelled, docs_of, spark):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0 or doc_id is null"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    wrong = [i for i, r in got.items() if i % 2 and r.toxic != (i % 5 == 0)]
    assert len(wrong) <= 5
    probe = docs_of([(1, "w1 w2 w3"), (2, "w1 nasty w3 nasty vile grubby"), (3, None), (4, ""), (2, "w1 nasty w3 nasty vile grubby"), (None, "w1"), (5, "vile " * 50_000)])
    rows = sorted(toxicity.severity(probe, model).collect(), key=lambda r: (r.doc_id or 0))
    assert [r.toxic for r in rows] == [False, False, True, True, False, False, rows[-1].toxic]
    assert all(r.severity >= 0 for r in rows) and rows[2].severity > rows[1].severity
    kept = toxicity.keep_civil(probe, model)
    assert kept.columns == probe.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.toxic}


def test_a_term_too_rare_in_the_sample_is_a_feature(docs_of, spark):
    rng = random.Random(6)
    rows = [(i, " ".join([*rng.choices([f"w{k}" for k in range(40)], k=20), *(["nasty"] if i % 4 == 0 else [])])) for i in range(800)]
    rows += [(1000 + i, f"{t} grim") for i, (_, t) in enumerate(rows[1:80:4])]  # their only sign
    labels = spark.createDataFrame([(i, int("nasty" in t or "grim" in t)) for i, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(rows), labels, toxicity.Settings(per_class=20))
    assert model.weights["grim"] > 0 and model.weights["nasty"] > 0
    got = {r.doc_id: r.severity for r in toxicity.severity(docs_of([(1, "w1 w2"), (2, "w1 w2 grim")]), model).collect()}
    assert got[2] > got[1]


def test_without_labels_nothing_is_toxic(labelled):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert toxicity.severity(docs, None).filter("toxic or severity > 0").count() == 0
    assert toxicity.fit(docs.limit(0), labels) is None


def test_url_rules_and_parts(spark):
    assert url_filter.host_path("HTTP://Ab.Example.NET/En/x?y/z#f") == ("ab.example.net", "/En/x")
    assert [url_filter.host_path(u) for u in (None, "", "x/y", "a://h", "a://h?q", "a://h#/p")] == [("", "")] * 3 + [("h", "")] * 3
    assert url_filter.match(RULES, "m.example.net", "/en/1") == ("allow", "example.net/en/")
    assert url_filter.match(RULES, "m.example.net", "/de/1") == ("block", "net/")
    assert url_filter.match(RULES, "notexample.com", "/de/1") is None and url_filter.match(RULES, "a.net", "") is None


def test_urls_are_judged(spark):
    table = url_filter.labelled_urls()
    weights = url_filter.fit(table)
    pages = spark.createDataFrame([(1, "https://www.casino-win.example.com/x", 0), (2, "http://news.example.org/en/1.html", 0), (3, None, 0), (4, "junk", 0),
                                   (5, "https://a.example.net/en/casino", 0), (5, "https://a.example.net/en/casino", 0)], "page_id long, url string, verdict int")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, RULES, weights).collect())
    assert got == [(1, None, "block"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "example.net/en/", "allow"), (5, "example.net/en/", "allow")]
    assert url_filter.judge(pages.limit(0), RULES, weights).count() == 0


def test_url_words_held_out():
    table = url_filter.labelled_urls()
    train, test = [r for i, r in enumerate(table) if (i // 8) % 4], [r for i, r in enumerate(table) if (i // 8) % 4 == 0]
    weights = url_filter.fit(train)
    right = sum((url_filter.probability(weights, *url_filter.host_path(u)) >= 0.5) == bool(y) for u, y in test)
    assert right / len(test) > 0.7


LONG = "This is the text of the article and it is long enough to be the main part of the page, with words that are all in the list."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p></p>", ""), ("<html><body><nav><a href=x>Menu</a></nav></body></html>", ""),
    ("<nav>Home</nav><article><h1>Head &amp; tail</h1><p>One<br>two  \n three<p>Four.</article><footer>&copy; us</footer>", "Head & tail One two three Four."),
    ("<article><p>Kept</p><div class='share-bar'>Share</div><aside>More</aside><section id=comments><p>I say</p></section><form>Name</form></article>", "Kept"),
    ('<article><script>var t="</p>";</script><style>p{}</style><p>x &lt;b&gt; &#233;&#x4e2d;</p><!-- <p>no</p> -->', "x <b> é中"),
    (f"<div class=menu><a href=/>Home</a></div><div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div>", f"Title {LONG} Short. {LONG}"),
    ("<article><p>unclosed <b>bold <p>and cut &am", "unclosed bold and cut &am"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    (f"<nav>Menu</nav><article><h3><a href=/n>Next story</a></h3></article><div><h2>Title</h2><p>{LONG}</p><p>Short.</p></div><footer>us</footer>", f"Title {LONG} Short."),
    (f"<article><h1>Head</h1><p>{LONG}</p><ul><li><a href=/a>One more</a></li><li>and</li><li><a href=/b>another one</a></li></ul></article>", f"Head {LONG}"),
    (f"<article><p>{LONG}</p></article><div>All rights with us</div><div><a href=/x>Elsewhere</a></div>", LONG),
    (f"<article><p>{LONG}</p></article><article><p>A second one</p></article>", f"{LONG} A second one"),
])
def test_an_article_does_not_decide_alone(page, text):
    assert html_text.main_text(page) == text


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é 中</article>", "x"), (1, "u", "<article>é 中</article>", "x"), (None, None, None, "y"),
                                   (2, "v", "<article>" + "<p>word</p>" * 30_000, "z")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 3), (1, 3), (2, 149_999)]


STORY = "The council met on Monday and said that it would not be the last of the meetings that the town has had about the bridge, which was built in a time when there were no cars. "


@pytest.mark.parametrize("wrapper", ['<main class="content no-sidebar">', '<article class="post has-comments">', '<div id="page" class="search-page">', '<div class="related">', '<div class="layout with-sidebar">'])
def test_names_of_wrappers_do_not_lose_the_story(wrapper):
    from armparity.llm import html_text

    tag = wrapper[1:].split()[0]
    page = f"<html><body><nav><a href=x>Home</a></nav>{wrapper}<p>{STORY * 2}</p></{tag}><div class='sidebar'><p>{STORY}</p></div></body></html>"
    assert html_text.main_text(page) == (STORY * 2).strip()


def test_names_still_mark_what_stands_beside_a_story():
    from armparity.llm import html_text

    page = f"<body><article><p>{STORY}</p></article><section id='comments'><article class='comment'><p>{STORY * 5}</p></article></section><div class='cookie-notice'><p>{STORY * 9}</p></div></body>"
    assert html_text.main_text(page) == STORY.strip()
    assert html_text.main_text(f"<body><article class='teaser related'><p>{STORY}</p></article><div><p>{STORY * 2}</p></div></body>") == (STORY * 2).strip()
    assert html_text.main_text("<body><div class='menu'><a href=x>One</a> <a href=y>Two</a></div></body>") == ""
