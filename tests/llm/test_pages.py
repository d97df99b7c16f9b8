import html
import random
import re
from collections import Counter
from math import floor

import regex
from pyspark.sql import functions as F

from brickloom.llm import html_text, mincut, queries, urls

SF = "/root/testdata/sf0.001"


def test_cut_against_all_labellings():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 8)
        s = [r.randint(-9, 9) for _ in range(n)]
        e = [(a, b, r.randint(0, 6)) for a in range(n) for b in range(a) if r.random() < 0.4]

        def cost(m, n=n, s=s, e=e):
            alone = sum(abs(x) for i, x in enumerate(s) if (x > 0) != bool(m >> i & 1) and x)
            return alone + sum(w for a, b, w in e if (m >> a & 1) != (m >> b & 1))

        side = mincut.source_side(s, e)
        assert cost(sum(1 << i for i, x in enumerate(side) if x)) == min(map(cost, range(1 << n)))


def test_pages_of_the_table(spark):
    for r, src in zip(
        sorted(queries.QUERIES["op4_main_text"](spark, SF).collect()), sorted(spark.read.parquet(f"{SF}/pages.parquet").collect()), strict=True
    ):
        article = re.search(r"<article>(.*?)</article>", src.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split("</?h1>|</?p>|<br>", article))
        assert r.text == " ".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == src.url


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header>
<div class="cookie-notice">We use cookies to improve things.</div><div id="content"><h1>Title of it</h1><div class=post>
<p>First para with some text &amp; more of it. It goes on and on.<p>Second <i>para</i>graph: text, more text. And again.</div>
<ul><li>One point to make.<li>Two points to make.</ul></div><script>var a="<p>no</p>";</script>
<div class="comments"><p>Great article, thanks for posting it. I liked it.</p></div><form><input>Subscribe now</form><footer>(c)</footer></body></html>"""


def test_page_without_article():
    assert html_text.main_text(PAGE) == (
        "Title of it First para with some text & more of it. It goes on and on. Second paragraph: text, more text. And again. "
        "One point to make. Two points to make."
    )


def test_hidden_elements_hide_only_themselves():
    one, two = "First para with some text. It goes on and on.", "Second para with some more text. It goes on as well."
    for x in [
        "<svg viewBox='0 0 1 1'/>", "<math/>", "<video src=x/>", "<video src=x>", "<object data=a/>", "<iframe src=x>", "<canvas>", "<audio><template>",
        "<object data=a><object data=b>inner</object>outer words</object>", "<SVG><title/><text>No</text></SVG>", "<svg><style>p{}</style><path/></svg>",
        "<video src=x><video src=y>No video</video>", "<noscript>Turn it on</noscript>", "<template><p>No</p></template>", "</video>", "<object><script>'</object>'</script>No</object>",
    ]:
        page = f"<html><body><article><p>{one}</p>{x}<p>{two}</p></article><svg><path/></svg><footer>(c)</footer></body></html>"
        assert html_text.main_text(page) == f"{one} {two}", x
        inside = page.replace(f"</p>{x}<p>", f" {x}</p><p>")
        assert html_text.main_text(inside) == f"{one} {two}", x
    assert html_text.main_text("<canvas>" * 20_000 + f"<article><p>{one}") == one
    assert html_text.main_text(f"<article><svg><title/><p>{one}") == one


WRAPPERS = [
    '<article class="post tag-python">', '<body class="post has-sidebar">', '<body class="no-sidebar"><main>', '<html class="js cookies">', '<section id="related-work">',
    '<div class="content-area with-side-nav">', '<div class="post type-post status-publish category-menu tag-search hentry">', '<body id="top" class="single single-post comments-open">',
    '<div class="layout layout--with-sidebar">', '<div class="page-with-sidebar"><article>', '<div id="content" class="mw-body" role="main">', '<section class="legal-history">',
    '<div class="story-body search-engines">', '<form id="aspnetForm"><main role="main">', '<div class="row skip-lazy"><div class="entry-content">', '<div class="sidebar-layout">',
    '<html class="no-js hidden-menu"><body class="ads-enabled"><div id="main">', '<article class="article share-price-report">', '<div class="right-sidebar"><main class="site-main">',
]
PARAGRAPHS = [f"Paragraph {k} tells of things that happened long ago. It has several sentences; they go on, and on." for k in (1, 2, 3)]


def test_names_of_wrappers_lose_no_article():
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    for w in WRAPPERS:
        assert html_text.main_text(w + body) == " ".join(PARAGRAPHS), w


def test_names_of_boilerplate_are_left_out():
    body, more = "".join(f"<p>{p}</p>" for p in PARAGRAPHS), "<p>Some words that are no part of it, although they read like a text. They go on.</p>"
    for x in [
        '<div id="comments">', '<ol class="comment-list"><li class="comment-42">', '<article class="comment byuser">', '<div class="related-posts">', '<div class="tags-links">', '<div class="widget">',
        '<div class="sidebar sidebar--left">', '<section class="social share-buttons">', '<div id="cookie-notice">', '<div role="navigation">', '<div class="notice">', '<div class="ad">',
    ]:
        assert html_text.main_text(f'<body class="single"><article class="post"><h1>Title</h1>{body}{x}{more}') == " ".join(["Title", *PARAGRAPHS]), x


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "v", PAGE, 1), (3, "w", "<p", 1), (3, "w", "<div " * 2000, 1), (4, "x", PAGE * 60, 1)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text int")
    got = html_text.extract(df.withColumn("page_id", df.page_id.cast("long"))).collect()
    assert [r.n_chars for r in got][:2] == [0, 0] and got[2].text.startswith("Title of it") and len(got) == 6
    assert html_text.extract(df.limit(0)).count() == 0


def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, None)))


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=/a#b", "https://a.example.com/en/2", "https://example.com/en", "ftp://x.net/es/1",
    "http://net/fr/", "http://y.netx/fr/1", "http://u@h.org:80/a//b/?q", "http://h.org#f", "http://a.com://b/c", "http://www.example.com/EN/1",
]


def test_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = plain_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def plain_shape(segment):
    return "*" + re.sub("[0-9]+", "0", regex.sub(r"\p{L}+", "a", segment))


def plain_tree(rows, p):
    """[(parts, blocked, labelled, given)] -> [(template, purity)], node by node."""
    where = [None] * len(rows)

    def smooth(b, n, prior):
        return (b + prior * p.weight) / (n + p.weight)

    def sums(ids):
        return sum(rows[i][1] for i in ids), sum(rows[i][2] for i in ids), sum(rows[i][3] for i in ids) / (len(ids) * urls.SCALE)

    def go(ids, depth, template, up):
        b, n, g = sums(ids)
        purity = smooth(b, n, g if up is None else (up + g) / 2)
        deep = [i for i in ids if len(rows[i][0]) > depth]
        groups = {}
        for i in ids:
            if i not in deep:
                where[i] = (template, purity)
        if len(deep) < p.support:
            for i in deep:
                groups.setdefault(plain_shape("/".join(rows[i][0][depth:])), []).append(i)
            closed = True
        else:
            closed, branch = False, {}
            for i in deep:
                branch.setdefault(rows[i][0][depth], []).append(i)
            after = {s: Counter(plain_shape(rows[i][0][depth + 1]) if len(rows[i][0]) > depth + 1 else "$" for i in v) for s, v in branch.items()}
            literal = {s: floor(smooth(*sums(v)) / p.band) for s, v in branch.items() if len(v) >= p.support and len(v) >= p.share * len(deep)}
            for s, v in branch.items():
                token = plain_shape(s)
                if s in literal:
                    peers = [x for x in literal if literal[x] == literal[s]]
                    total, pool = sum(len(branch[x]) for x in peers), sum((after[x] for x in peers), Counter())
                    met = sum(min(c * total, pool[x] * len(v)) for x, c in after[s].items())
                    token = f"~{literal[s]}" if len(peers) > 1 and met >= p.alike * len(v) * total else "=" + s
                groups.setdefault(token, []).extend(v)
        for token, v in groups.items():
            if closed:
                path = [*template, token]
                b, n, g = sums(v)
                for i in v:
                    where[i] = (path, smooth(b, n, (purity + g) / 2))
            else:
                go(v, depth + 1, [*template, token], purity)

    # a node's own sums hold all of its paths, so nodes of equal template are one
    go(list(range(len(rows))), 0, [], None)
    return where


def plain_templates(pages, p):
    paths = {}
    for host, path, label in pages:
        b, n = paths.get((host, path), (0, 0))
        paths[host, path] = (b + (label or 0), n + (label is not None))
    base = (sum(b for b, _ in paths.values()) + 0.5 * p.weight) / (sum(n for _, n in paths.values()) + p.weight)
    given, out = dict.fromkeys(paths, floor(base * urls.SCALE + 0.5)), {}
    for scope in (lambda h: "*", lambda h: ".".join(h.split(".")[-2:]), lambda h: h):
        hosts = {}
        for key in paths:
            hosts.setdefault(scope(key[0]), []).append(key)
        for keys in hosts.values():
            rows = [(path[1:].split("/") if path else [], *paths[host, path], given[host, path]) for host, path in keys]
            out.update(zip(keys, plain_tree(rows, p), strict=True))
        given = {k: floor(out[k][1] * urls.SCALE + 0.5) for k in paths}
    return {k: ("/".join(t), purity) for k, (t, purity) in out.items()}


def check_templates(spark, rows, params=urls.TreeParams()):
    df = spark.createDataFrame(rows, "host string, path string, label int")
    got = {(r.host, r.path): (r.template, r.purity) for r in urls.path_templates(df, params).collect()}
    want = plain_templates(rows, params)
    assert got.keys() == want.keys()
    for k, (template, purity) in want.items():
        assert got[k][0] == template and abs(got[k][1] - purity) < 1e-9, k
    return got


def test_templates_against_plain_trees(spark):
    r = random.Random(5)
    rows = []
    for _ in range(900):
        host = r.choice(["a.x.org", "b.x.org", "c.y.org", "", "solo"])
        parts = [r.choice(["en", "de", "fr", "", "été"])] + [r.choice(["news", "tag", str(r.randint(1, 99)), f"p-{r.randint(1, 9)}.html"]) for _ in range(r.randint(0, 4))]
        path = r.choice(["", "/", "/" + "/".join(parts), "/" + "/".join(parts), "/deep" * r.randint(5, 6) + f"/{r.randint(1, 9)}", "/" + "q" * 60 + str(r.randint(1, 9))])
        rows.append((host, path, None if r.random() < 0.5 or host == "c.y.org" else int("en" in path or r.random() < 0.1)))
    check_templates(spark, rows)


def test_templates_learn_from_labelled_paths(spark):
    rows = [("h", f"/spam/{i}/x", 1) for i in range(60)] + [("h", f"/news/{i}", 0) for i in range(60)]
    rows += [("h", f"/spam/{900 + i}/x", None) for i in range(5)] + [("h", f"/other/{i}.html", None) for i in range(40)]
    rows += [("other", f"/spam/{i}/x", None) for i in range(5)]
    got = check_templates(spark, rows)
    assert len(got) == len(rows)
    assert got["h", "/spam/901/x"][1] > 0.8 and got["h", "/news/3"][1] < 0.2 and 0.2 < got["h", "/other/3.html"][1] < 0.7
    assert got["h", "/spam/901/x"][0] == got["h", "/spam/7/x"][0] and got["other", "/spam/1/x"][1] > 0.7


def test_hidden_pages_are_judged_rightly(spark):
    pages = spark.read.parquet(f"{SF}/../sf0.1/pages.parquet")  # on sf0.01 2 of 14 hidden blocked pages are missed
    ruled = pages.select(urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    ruled = ruled.withColumn("r", urls.rule_of(F.col("host"), F.col("path"))).withColumn("label", F.when(F.col("r.verdict") == "block", 1).when(F.col("r").isNotNull(), 0))
    seen = urls.path_templates(ruled.select("host", "path", F.when(~urls.hidden(F.col("host"), F.col("path")), F.col("label")).alias("label")))
    tried = ruled.filter(urls.hidden(F.col("host"), F.col("path"))).filter("label IS NOT NULL").withColumn("n", F.lit(1))
    at, caught, wrong = urls.threshold(tried.join(seen, ["host", "path"]))
    assert 0.1 < at < 0.9 and caught >= 0.9 and wrong <= 0.05
    assert urls.threshold(tried.join(seen, ["host", "path"]).filter("label = 1"))[0] == 0.5
    verdicts = {r.verdict for r in urls.judge(pages).filter("rule IS NULL").collect()}
    assert verdicts == {"allow", "block"}
