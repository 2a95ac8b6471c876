import random
import time

import pytest

from manyfold.llm import html_text as X
from manyfold.llm.html_text import extract, main_text

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><a href=x>menu</a></nav><div class="ad banner">buy, buy, buy this thing that is long, please</div>
<div class="cookie-notice"><p>We use cookies, as all do, for reasons, and more reasons.</p></div>
<article><h1>Head</h1><p><b>One,  two &amp; three &lt;tag&gt; and
 more words that count.<br><p>Second &eacute; paragraph, with words, commas, and all that.<!-- no --><form><input>send</form><ul><li>a<li>b</ul>
<aside>aside text, long, and with commas, to tempt</aside></article>
<div id="comments"><p>A reader's comment, long, with commas, many, and more of them, yes.</p></div><footer>&copy; foot</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Head One, two & three <tag> and more words that count. Second é paragraph, with words, commas, and all that. a b"


def test_container_by_score():
    body = "".join(f"<p>Sentence {i}, with some words, and commas, to make it count.</p>" for i in range(6))
    page = f"<body><div class=x><a href=1>link one that is long enough</a> <a href=2>another link, long, here</a></div><div class=y>{body}</div><div class=sidebar>{body}</div></body>"
    assert main_text(page) == " ".join(f"Sentence {i}, with some words, and commas, to make it count." for i in range(6))


def test_names_of_parts_and_of_layouts():
    body = "".join(f"<p>Sentence {i}, with some words, and commas, to make it count.</p>" for i in range(6))
    text = " ".join(f"Sentence {i}, with some words, and commas, to make it count." for i in range(6))
    parts = "".join(f"<div class='{c}'><p>Other words, many of them, with commas, as bait, here.</p></div>" for c in ("sideBar", "cookieNotice", "reader-comments", "adsbygoogle", "share-buttons", "top_nav", "related-posts 3"))
    assert main_text(f"<body><div class='page has-sidebar no-banner'>{parts}<div class='entry'>{body}</div></div></body>") == text
    assert main_text(f"<body><article class='post with-comments'>{body}{parts}</article></body>") == text


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "plain  text", "<p>", "<<>&am <b", "<p>short</p>")] == ["", "", "plain text", "", "<<>&am <b", "short"]
    assert main_text("<article>&amp;amp; x</article>") == "&amp; x"
    deep = "<div>" * 5000 + "deep text that goes on, and on, and on" + "</div>" * 5000
    assert main_text(deep) == "deep text that goes on, and on, and on"
    words = " ".join(["word"] * 200_000)
    assert main_text(f"<article><p>{words}</p></article>") == words


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text[:4]) for r in extract(df).collect()), key=str)
    assert got == [(1, "u", "Head"), (1, "u", "Head"), (None, None, "")]
    assert extract(df.limit(0)).count() == 0


def brute_scores(root):
    """Every container's score by the definition, from each paragraph anew."""
    def kept(node):
        return [c for c in node.children if isinstance(c, str) or not c.dropped]

    def text(node, inner=True):
        return sum(len(c.strip()) if isinstance(c, str) else text(c, inner) if inner or c.tag not in X.BLOCKS else 0 for c in kept(node))

    def commas(node):
        return sum(c.count(",") if isinstance(c, str) else commas(c) for c in kept(node))

    def links(node):
        return sum(0 if isinstance(c, str) else text(c) if c.tag == "a" else links(c) for c in kept(node))

    def every(node):
        yield node
        for c in kept(node):
            if not isinstance(c, str):
                yield from every(c)

    raw = {}
    for node in every(root):
        if node.tag in X.PARAGRAPHS and text(node, False) >= X.LEAST_PARAGRAPH:
            up, shares = node.parent, list(X.SHARES)
            while up is not None and shares:
                if up.tag in X.BLOCKS:
                    raw[up] = raw.get(up, 0) + (1 + commas(node) + min(text(node) / 100, 3)) * shares.pop(0)
                up = up.parent
    out = {}
    for node, points in raw.items():
        points += 25 * bool(X.GOOD_NAMES.search(node.names)) + 25 * (node.tag in ("article", "main") or node.role == "main") + 5 * (node.tag in ("div", "section"))
        out[node] = points * (1 - links(node) / max(1, text(node)))
    return out


def generated(rng, depth=0):
    tag = rng.choice(["div", "section", "article", "p", "p", "p", "ul", "span", "a", "blockquote", "main", "h2", "b"])
    name = rng.choice(["", "", ' class="content"', " id='related'", " class=ad", ' class="header x"', " id=post-1"])
    inner = "".join(generated(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else rng.choice(["Words here, and more of them, to count. ", "short ", "plain words without any sign that go on for quite a while "]) for _ in range(rng.randrange(4)))
    return f"<{tag}{name}>{inner}" + (f"</{tag}>" if rng.random() < 0.9 else "")


def test_scores_against_brute_force():
    rng, decided = random.Random(5), 0
    for _ in range(300):
        root, found = X.scored_tree("<body>" + "".join(generated(rng) for _ in range(4)))
        want = brute_scores(root)
        assert set(found) == set(want)
        assert all(abs(n.score - want[n]) < 1e-9 * max(1, want[n]) for n in found)
        best = max(found, key=lambda n: n.score, default=None)
        decided += best is not None and best.tag not in ("article", "main")
    assert decided > 100  # pages whose container only the score tells


BODY = "".join(f"<p>Sentence {i}, with some words, and commas, to make it count.</p>" for i in range(6))
TEXT = " ".join(f"Sentence {i}, with some words, and commas, to make it count." for i in range(6))


def test_score_decides_between_articles():
    teaser = "<article class=teaser><p>Another story, told in short, to read on.</p></article>"
    assert main_text(f"<body>{teaser}<article>{BODY}</article>") == TEXT
    assert main_text(f"<main>{teaser}{teaser}</main><div class=story>{BODY * 8}</div>") == " ".join([TEXT] * 8)


def test_names_inside_the_article():
    assert main_text(f"<article><h1 class='section-header'>Head</h1>{BODY}<p class=notice>Stays, since a paragraph's name says little.</p></article>") == f"Head {TEXT} Stays, since a paragraph's name says little."
    assert main_text(f"<div id=search-page><div class=related-work>{BODY}</div></div>") == TEXT  # half of all points and more
    assert main_text(f"<article>{BODY}<div class=related><p>Other stories, many of them, as bait.</p></div><p class=ad>Buy, buy, buy this thing, now.</p></article>") == TEXT


def test_parts_of_an_article_in_containers():
    half = BODY.replace("Sentence", "Other")
    assert main_text(f"<article><div>{BODY}</div><div>{half}</div></article>") == f"{TEXT} {TEXT.replace('Sentence', 'Other')}"
    assert main_text(f"<article><h1>Head</h1><div class=text>{BODY}</div></article>") == f"Head {TEXT}"


def test_attributes_and_heads():
    assert main_text(f"<head><title>x</title><body><article><p>See <a href=http://x/>this, the linked page</a> and so on, at length, here.</p>{BODY}</article>").startswith("See this, the linked page and so on, at length, here.")
    assert main_text('<article><p title="a > b">Words behind a quoted sign, that count.</p></article>') == "Words behind a quoted sign, that count."
    assert main_text('<article><p title="never closed>Words behind it, that count as well.</p></article>') == "Words behind it, that count as well."
    assert main_text("<article><p>x &lt; y <math><mi>E</mi>=<mi>m</mi></math> 3 < 4, said they, in earnest</p></article>") == "x < y E=m 3 < 4, said they, in earnest"


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<p><button><div>", '<a "', "<a '\"", "</b>", "<b>", "<textarea>", "<li><ul>", "<td>", "<!--", "<![", "a<", "&", "<div class='x", "<p>words, and words, and more words here", "<span><p>"])
def test_time_grows_with_the_page(unit):
    def seconds(n):
        began = time.process_time()
        main_text(unit * (n // len(unit)))
        return time.process_time() - began

    seconds(1000)
    assert seconds(160_000) < 50 * max(seconds(20_000), 0.005)
