import re
from collections import Counter

import pytest

from strataforge.llm import op1_html as html
from strataforge.llm import op8_urls as urls


def body(inner, tail="<footer>&copy; x</footer>"):
    return f"<!DOCTYPE html><html><head><title>T t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav>{inner}{tail}</body></html>"


PAGE = body('<!-- ad 1 --><div class="ad">Buy this now please.</div><article><h1>Big&amp;  news</h1><p>First <b>bold</b>&nbsp;one.\n Next<p>Second &eacute;t&#233;.<br>Third<div class="advert">no no no no no no no no no no</div><p>Last words here.</p></article><div class="comments"><p>I liked this a lot and write many words about it</p></div>')


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), (PAGE, "Big& news First bold one. Next Second été. Third Last words here."),
    (body("<main><h2>Head</h2><ul><li>one two three</li><li>four five six</li></ul></main><aside>side bar words</aside><form>name <input></form>"), "Head one two three four five six"),
    (body("<article><p>some words that stay here</p><!-- unclosed <p>gone"), "some words that stay here"),
    (body("<article><p>some words that stay here</p><script>if (a</article>b) x", ""), "some words that stay here"),
    (body('<article><p hidden>secret</p><p>an open text with <a href="/x">a link</a> in it</p></article>'), "an open text with a link in it"),
])
def test_extraction(page, want):
    assert html.default_extractor().extract(page) == want


def test_held_out_pages():
    """Pages of the labelled layouts that training has not seen: hardly a content word is missing, hardly another is there."""
    ex, words, missing, extra = html.default_extractor(), 0, 0, 0
    for page in html.labelled_pages(seed=5, size=100):
        want = " ".join(re.findall("\x01(.*?)\x02", page)).split()
        got = ex.extract(page.replace("\x01", "").replace("\x02", "")).split()
        words += len(want)
        missing += sum((Counter(want) - Counter(got)).values())
        extra += sum((Counter(got) - Counter(want)).values())
    assert missing < 0.005 * words and extra < 0.005 * words


#: Written by hand in layouts of their own: (page, main text).
HAND = [
    (
        """<html><head><title>Town gets a bridge</title><link rel=stylesheet href=a.css></head><body class="home"><div id="masthead"><a href=/>The Courier</a> <span>Since 1901</span></div>
        <ul class="menu"><li><a href=/n>News</a><li><a href=/s>Sport</a><li><a href=/w>Weather</a></ul>
        <div class="wrapper"><div class="story"><h1>Town gets a bridge</h1><p class="lead">After ten years of planning the new bridge opened on Monday.</p>
        <p>Hundreds of people walked across it in the <em>first</em> hour, and many came <a href=/x>by boat</a> to watch.</p><div class="advert">Cheap shoes, today only!</div>
        <p>The mayor thanked the builders &mdash; and the rain that stopped in time.</p></div></div>
        <div class="sidebar"><h3>Most read</h3><ol><li><a href=/1>Cat found</a><li><a href=/2>Rain again</a></ol></div><div class="footer">&copy; The Courier. All rights reserved.</div></body></html>""",
        "Town gets a bridge After ten years of planning the new bridge opened on Monday. Hundreds of people walked across it in the first hour, and many came by boat to watch. The mayor thanked the builders \u2014 and the rain that stopped in time.",
    ),
    (
        """<body><header><a href="/">Kitchen notes</a><nav><a href="/a">Soups</a> <a href="/b">Bread</a></nav></header><main><article><header><h1>Plain bread</h1></header>
        <p>Mix flour, water, salt and a little yeast, and let the dough rest overnight.</p><h2>Baking</h2><ol><li>Heat the oven well.</li><li>Bake for forty minutes.</li></ol>
        <figure><img src=b.jpg><figcaption>A loaf that came out well</figcaption></figure></article><section class="comments"><h2>Comments</h2><p>My loaf was flat, what did I do wrong here?</p></section></main>
        <aside><p>Get our weekly letter with new recipes for free.</p></aside><footer><p>Imprint and privacy</p></footer></body>""",
        "Plain bread Mix flour, water, salt and a little yeast, and let the dough rest overnight. Baking Heat the oven well. Bake for forty minutes. A loaf that came out well",
    ),
    (
        """<body><table><tr><td><form action=/s>Search this site <input name=q><button>Go</button></form></td></tr></table><div id="page"><div class="entry-content"><p>Snails move slowly, but they get far in a night of rain.</p>
        <p>They find their way by smell; a garden wall is no hindrance.</p></div></div><div role="contentinfo">Contact us by letter only</div><script>track("p")</script></body>""",
        "Snails move slowly, but they get far in a night of rain. They find their way by smell; a garden wall is no hindrance.",
    ),
]


@pytest.mark.parametrize("page, want", HAND)
def test_hand_written_pages(page, want):
    assert html.default_extractor().extract(page) == want


def test_names_do_not_delete_prose():
    """Names that often stand for boilerplate don't outweigh an article's paragraphs."""
    prose = "The harbour was quiet that morning, and the fishers mended their nets in the sun."
    page = body(f'<article><h1>Morning</h1><p>{prose}</p><div class="story-related"><p>{prose}</p></div><p id="form">{prose}</p></article>')
    assert html.default_extractor().extract(page) == f"Morning {prose} {prose} {prose}"


def test_only_the_scan_leaves_out_a_far_run():
    """Judged alone a teaser far from the story is as good as its paragraphs; the region does without it."""
    prose = "The harbour was quiet that morning, and the fishers mended their nets in the sun."
    links = "".join(f'<li><a href="/{i}">place {i}</a></li>' for i in range(60))
    page = f"<html><body><div><p>A teaser for quite another story, with enough words of its own to look like one.</p></div><ul>{links}</ul><div><p>{prose}</p><p>{prose}</p><p>{prose}</p></div><ul>{links}</ul><div><p>One more teaser with as many words as the first had, which leads to other pages.</p></div></body></html>"
    ex = html.default_extractor()
    items = html.page_items(page)
    alone = " ".join(items[i][1] for i, n, names in html.word_features(items) if ex.weight(names) > 0)
    assert "teaser" in alone and ex.extract(page) == f"{prose} {prose} {prose}"


def test_lengths_that_change_in_lower_case():
    page = body("<article><p>\u0130stanbul \u0130zmir \u0130znik are three towns</p><SCRIPT>var x = 1;</SCRIPT><p>hello world of words</p></article>")
    assert html.default_extractor().extract(page) == "\u0130stanbul \u0130zmir \u0130znik are three towns hello world of words"


def test_unclosed_quotes_take_linear_time():
    import time

    ex = html.default_extractor()
    for unit in ('<a "', "<a '\"", "<a x=\"'>b", "<b '>", '<a ">', "<p><a href='\"' ", "<script>", "<!-- ", "<"):
        for end in ("", "<b>" * 50_000):
            began = time.perf_counter()
            ex.extract(unit * 50_000 + end)
            assert time.perf_counter() - began < 15, unit
    assert ex.extract('<article><p title="a>b">some words in here</p><p title="open>more words in here</p></article>') == "some words in here more words in here"


def test_region_is_the_best_of_all():
    """The linear scan against all contiguous regions."""
    ex = html.default_extractor()
    for page in html.labelled_pages(seed=9, size=8):
        items = html.page_items(page)
        first, last, _ = ex.region(items)
        weights = {i: (n, ex.weight(f)) for i, n, f in html.word_features(items)}
        value = [(lambda n, w: n * w if w > 0 else w)(*weights.get(i, (0, 0.0))) if x[0] is None else ex.tag_weights.get(x[0], ex.other_tag) for i, x in enumerate(items)]
        sums = [0.0]
        for v in value:
            sums.append(sums[-1] + v)
        best = max(sums[b] - sums[a] for a in range(len(sums)) for b in range(a, len(sums)))
        assert sums[last] - sums[first] == pytest.approx(best)


def test_long_page_and_clashing_columns(spark):
    long = body("<article>" + "<p>word and more words</p>" * 20_000 + "</article>")
    rows = [(1, "u", long, "x", 5), (1, "u", long, "x", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract_text(df).collect()
    assert [r["n_chars"] for r in got] == [20_000 * 20 - 1] * 2 + [0] and got[2]["text"] == ""
    assert html.extract_text(df.limit(0)).collect() == []


CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme", "", "", None), ("http://", "", "", None), ("https://A.Example.COM/en/1?q=/x#y", "a.example.com", "/en/1", "example.com/en/"),
    ("http://www.example.com/en/x", "www.example.com", "/en/x", "www.example.com/en/"), ("http://x.www.example.com/en/", "x.www.example.com", "/en/", "www.example.com/en/"), ("http://example.com", "example.com", "", None),
    ("http://example.com/de/", "example.com", "/de/", "com/"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("http://a.net/es/1", "a.net", "/es/1", "net/es/"), ("http://net/fr/", "net", "/fr/", "net/fr/"),
    ("http://a.net?x=/es/", "a.net", "", None), ("x://É.net#/es/", "É.net", "", None), ("http://a.org/en/", "a.org", "/en/", None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, (u, *_) in enumerate(CASES)], "page_id long, url string, rule string, score double")
    got = {r["page_id"]: r for r in urls.judge_urls(df).collect()}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == ("allow" if rule in ("com/", "www.example.com/en/") else "block")
        else:
            assert got[i]["verdict"] == ("block" if got[i]["score"] >= 0.5 else "allow")
    assert urls.judge_urls(df.limit(0)).count() == 0 and urls.judge_urls(df.union(df)).count() == 2 * len(CASES)


def test_rules_against_brute_force():
    table = urls.RuleTable(urls.CONTRACT_RULES)
    for host in ("com", "net", "a.net", "example.com", "b.www.example.com", "xexample.com", "www.example.com", "org", ""):
        for path in ("", "/", "/en", "/en/", "/es/x", "/fr/", "/en/es/"):
            fits = [(h + p, v) for h, p, v in urls.CONTRACT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            assert table.find(host, path) == (max(fits, key=lambda x: len(x[0])) if fits else (None, None))


def test_held_out_hosts():
    """Hosts that training has not seen, in four folds."""
    rows = urls.labelled_urls()
    host_of = lambda u: urls.split_url(u)[0]
    hosts = sorted({host_of(u) for u, _ in rows})
    right = total = 0
    for fold in range(4):
        out = {h for i, h in enumerate(hosts) if i % 4 == fold}
        held = lambda u: host_of(u) in out
        model = urls.train_url_model([r for r in rows if not held(r[0])])
        test = [r for r in rows if held(r[0])]
        right += sum((model.score(*urls.split_url(u)) >= 0.5) == bad for u, bad in test)
        total += len(test)
    assert right / total > 0.85
    with pytest.raises(ValueError):
        urls.train_url_model(rows, max_rows=10)


#: Urls of neither the labelled table nor the test tables: (url, blocked).
OTHER_URLS = [
    ("http://casino-jackpot.example/spin?bonus=1", True), ("https://cheap-pills-online.example/order", True), ("http://ads.bannerfarm.example/click?id=3", True), ("https://free-adult-cams.example/join", True), ("http://viagra-discount.example/buy-now", True), ("http://loans-instant-cash.example/apply", True),
    ("https://www.natural-history-museum.example/about", False), ("http://library.smalltown.example/events/calendar", False), ("https://docs.compiler.example/install.html", False), ("https://blog.woodworking.example/2020/05/bench", False), ("http://weather.mountains.example/archive/", False), ("https://physics.school.example/courses/optics", False),
]


def test_other_urls():
    model = urls.default_model()
    assert sum((model.score(*urls.split_url(u)) >= 0.5) == bad for u, bad in OTHER_URLS) >= 11
