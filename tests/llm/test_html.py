"""Main text of pages: markup, templates, odd rows."""

import random
from collections import Counter

from recospark.llm import html

ARTICLE = "<article><h1>Title {0}</h1><p><b>First {0} &amp; more.<br><p>Second  para\n{0}.</p></article>"


def page(i, body):
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>x{i}</a></li></ul></nav>{body}<footer>f</footer></body></html>'


def text(source, template=()):
    return html.main_text(html.parse(source), set(template))


def test_markup():
    assert text(page(1, '<!-- c --><div class="ad">buy</div>' + ARTICLE.format(1))) == "Title 1\nFirst 1 & more.\nSecond para 1."
    assert text(None) == text("") == text("<") .strip("<") == ""
    assert text("plain &lt;b&gt; text") == "plain <b> text"
    assert text('<body><aside>s</aside><div class="cookie-notice">n</div><form>f</form><p>a<p>b') == "a\nb"
    assert text('<article><p>a</p><section class="comments"><p>c</p></section></article><article class="comment">d</article>') == "a"
    assert text('<div class="no-sidebar"><article>a<table><tr><td>1<td>2</table></article></div>') == "a\n1\n2"
    assert text("<body><script>x") == "" and text("<p " + "<a" * 20000) is not None
    assert text("<div>" * 5000 + "deep" + "</b></div>" * 5000) == "deep"


def test_what_classes_must_not_delete():
    assert text('<body><div class="content has-sidebar"><h1>T</h1><p>Body text</p></div></body>') == "T\nBody text"
    assert text('<body><div id="wrap" class="social-science"><h1>T</h1><p>Body text</p></div></body>') == "T\nBody text"
    assert text('<article><p>One</p><p class="alert">Storm alert text</p><p class="ad">buy</p></article>') == "One\nStorm alert text"
    assert text("<article><p>Let <math><mi>x</mi></math> be <label>so</label> and <svg><text>n</text></svg> too.</p></article>") == "Let x be so and n too."
    assert text('<form id="page"><div class="page-header">h</div><p>All of the long text of this page</p></form><form><label>Name</label></form>') == "All of the long text of this page"
    assert text('<p>A post of two lines or so.</p><div id="comments"><p>A long comment that says more than the post</p></div>') == "A post of two lines or so."


def plain(source, template):
    """Main text by recursion over a tree of its own: for pages of nav, div, section, article, p and h1 without classes."""
    import re

    top = ["", []]
    stack = [top]
    for close, tag, said in re.findall(r"<(/?)([a-z0-9]+)>|([^<]+)", source):
        if said:
            stack[-1][1].append(said)
        elif close:
            stack.pop()
        else:
            node = [tag, []]
            stack[-1][1].append(node)
            stack.append(node)

    def flat(node):
        return node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(flat, node[1])) + f"</{node[0]}>"

    def has(node):
        return not isinstance(node, str) and (node[0] == "article" or any(map(has, node[1])))

    def walk(node, inside, only):
        if isinstance(node, str):
            return [node] if inside or not only else []
        if node[0] == "nav" or node[0] not in ("html", "body", "") and not has(node) and flat(node) in template and not (inside and node[0] in ("p", "h1")):
            return []
        return [x for c in node[1] for x in walk(c, inside or node[0] == "article", only)]

    return "\n".join(walk(top, False, has(top))), {flat(n) for n in _nodes(top) if not has(n) and n[0] not in ("html", "body", "")}


def _nodes(node):
    for c in node[1]:
        if not isinstance(c, str):
            yield c
            yield from _nodes(c)


def test_against_plain_version(spark):
    """Counts of subtrees and texts, host by host, against plain Python on random pages of shared and own parts."""
    rng = random.Random(4)
    parts = [f"<{t}><p>{w}</p><p>{w} more</p></{t}>" for t in ("div", "section") for w in ("menu", "advert", "notice", "rare")]

    def made(i):
        body = [rng.choice(parts[:6]) if rng.random() < 0.7 else rng.choice(parts) for _ in range(rng.randint(0, 3))]
        body.insert(rng.randint(0, len(body)), f"<article><h1>t{i}</h1><p>own {i}</p>{rng.choice(['', *parts])}</article>" if i % 3 else f"<div><p>own text {i}</p></div>")
        return "<html><body><nav><p>x</p></nav>" + "".join(body) + "</body></html>"

    rows = [(i, f"http://h{i % 3}.example.com/{i}", made(i)) for i in range(90)]
    seen = Counter()
    for host, own in {(url.split("/")[2], frozenset(plain(h, ())[1])) for _, url, h in rows}:
        seen.update((host, x) for x in own)
    want = {i: plain(h, {x for (host, x), n in seen.items() if host == url.split("/")[2] and n >= html.MIN_PAGES})[0] for i, url, h in rows}
    got = {r.page_id: r.main_text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want and sum("advert" in x for x in got.values()) < sum("advert" in h for *_, h in rows)


def test_templates(spark):
    box = "<div><p>Read this every day</p></div>"
    rows = [(i, f"http://Site.example.com/{i}", page(i, ARTICLE.format(i).replace("</article>", box + "</article>"))) for i in range(12)]
    # Copies of an article, and a paragraph that many articles share, stay.
    rows += [(100 + i, "http://copies.example.com/", page(0, "<article><div><p>same</p></div></article>")) for i in range(12)]
    rows += [(200 + i, f"http://p.example.com/{i}", page(i, f"<article><p>shared</p><p>{i}</p></article>")) for i in range(12)]
    rows += [(300 + i, f"http://q.example.com/{i}", page(i, f"<div><p>menu</p></div><div><p>own {i}</p></div>")) for i in range(12)]
    rows += [(400, None, None), (401, "odd", ""), (None, "http://site.example.com", page(5, ARTICLE.format(77)))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.main_text for r in html.extract(pages).collect()}
    assert got[3] == "Title 3\nFirst 3 & more.\nSecond para 3."
    assert got[105] == "same" and got[207] == "shared\n7" and got[302] == "own 2"
    assert got[400] == got[401] == "" and got[None].startswith("Title 77")
    assert html.extract(pages.limit(0)).count() == 0
    kept = html.BROADCAST_ROWS
    try:
        html.BROADCAST_ROWS = 0
        assert {r.page_id: r.main_text for r in html.extract(pages).collect()} == got
    finally:
        html.BROADCAST_ROWS = kept


def test_templates_of_a_large_host(spark, monkeypatch):
    """A section's box and a rotating advert are template, however many other pages the host has."""
    box, advert = "<section><p>Section menu</p></section>", "<div><p>Advert {0}</p></div>"
    rows = [(i, f"http://big.example.com/{i}", page(i, ARTICLE.format(i).replace("</article>", (box if i < 6 else "") + advert.format(i % 16) + "</article>"))) for i in range(96)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for most in (html.BROADCAST_ROWS, 0):
        monkeypatch.setattr(html, "BROADCAST_ROWS", most)
        got = {r.page_id: r.main_text for r in html.extract(pages).collect()}
        assert got == {i: f"Title {i}\nFirst {i} & more.\nSecond para {i}." for i in range(96)}
