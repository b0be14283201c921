"""HTML extraction and URL filtering."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bloom, html_extract, html_pages, queries, urls

TITLE, ONE, TWO = "A title", "The first paragraph of the text, which is rather long so that it looks like one.", "And then a second one follows, with a link in it, for good measure."
ARTICLE = f"<h1>{TITLE}</h1><p>{ONE}</p><p>And then a second one\n follows,<br>with <a href=x>a link</a> in it, for good measure.</p>"
WANT = f"{TITLE}\n{ONE}\n{TWO}"
FRAMES = {
    "article": f"<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class=ad>Buy now</div><article>{ARTICLE}</article><footer>&copy; x</footer>",
    "main": f"<header><h1>Site name</h1></header><main>{ARTICLE}<form><p>Your mail</p><input><button>Go</button></form></main>",
    "content": f'<div id="sidebar"><h3>More</h3><p>Other things to read here</p></div><div class="post-content">{ARTICLE}</div><div class="comments"><div class="comment"><p>I liked this very much, thank you for writing it.</p></div></div>',
    "notice": f'<div class="cookie-notice"><p>We use cookies to make this better for you.</p></div><article class="story">{ARTICLE}</article><aside><p>Related reading and other things</p></aside>',
    "unclosed": f"<script>var a='<p>no</p>';</script><style>p{{}}</style><nav><a href=/>x</a></nav><article>{ARTICLE}<footer>end",
}


@pytest.fixture(scope="module")
def model():
    return html_extract.fit()


@pytest.mark.parametrize("name", FRAMES)
def test_frames(model, name):
    assert model.extract(f"<!DOCTYPE html><html><head><title>t</title></head><body>{FRAMES[name]}</body></html>") == WANT


def test_held_out_accuracy(model):
    right = total = 0
    for page in html_pages.labelled_pages(150, seed=99):
        labels = html_extract.Dom(page, labels=True).labels
        dom = html_extract.Dom(re.sub(r' data-y="\d"', "", page))
        for hidden, p, y in zip(dom.hidden, model.marginals(dom), labels, strict=True):
            if not hidden:
                right += (p > 0.5) == bool(y)
                total += 1
    assert right / total > 0.97


def test_messages_are_exact(model):
    """Marginals of small trees against the sum over all assignments."""
    import itertools
    import math

    for page in ("<nav><ul><li><a href=/>x</a></li></ul></nav><p>text here</p>", "<div class=ad><p>t</p></div><article><h1>a</h1><p>b <b>c</b></p></article>"):
        dom = html_extract.Dom(page)
        seen, n = html_extract.evidence(dom), len(dom.tags)
        odds = [-30.0 if h else sum(model.emit.get(html_extract._event(k, s), 0.0) for s in w) for h, (k, w) in zip(dom.hidden, seen, strict=True)]
        weight = {}
        for ys in itertools.product((0, 1), repeat=n):
            log = sum(o * y for o, y in zip(odds, ys, strict=True)) + sum(model.pair.get(seen[i][0], model.any_pair)[ys[dom.parents[i]]][ys[i]] for i in range(1, n))
            weight[ys] = math.exp(log)
        total = sum(weight.values())
        for i, p in enumerate(model.marginals(dom)):
            assert abs(p - sum(w for ys, w in weight.items() if ys[i]) / total) < 1e-9


def other_pages(n, seed):
    """Pages of another grammar than the training pages': other names, layout by tables and nested boxes, sections in the
    article, menus without lists, definition lists, captions, inline formulas."""
    rng = random.Random(seed)

    def say(a, b):
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 11))) for _ in range(rng.randint(a, b)))

    def article():
        parts = [f"<h1 class=headline>{say(2, 8)}</h1>", f"<p class=lead>{say(8, 40)}</p>"]
        for _ in range(rng.randint(2, 6)):
            parts.append(rng.choice([
                lambda: f"<section><h2>{say(1, 6)}</h2><p>{say(10, 80)}</p><p>{say(10, 80)} <a href=x>{say(1, 4)}</a>, {say(2, 9)}</p></section>", lambda: f"<p>{say(10, 90)} <math><mi>{say(1, 1)}</mi><mo>=</mo><mn>2</mn></math> {say(3, 9)}</p>",
                lambda: f"<dl><dt>{say(1, 3)}<dd>{say(4, 20)}<dt>{say(1, 3)}<dd>{say(4, 20)}</dl>", lambda: f"<ol><li>{say(4, 20)}<li>{say(4, 20)}</ol>", lambda: f"<figure><img src=a.png><figcaption>{say(3, 15)}</figcaption></figure>",
            ])())
        return "".join(parts)

    for _ in range(n):
        menu = "".join(f'<a href="/{say(1, 1)}">{say(1, 2)}</a> | ' for _ in range(rng.randint(3, 9)))
        top = f'<div data-y="0" class="{rng.choice(["hd", "globalhead", "navigation-bar"])}">{menu}</div>'
        side = f'<div data-y="0" class="{rng.choice(["rail", "sidebar-right", "promo-column"])}"><h4>{say(1, 4)}</h4>' + "".join(f"<div><a href=y>{say(3, 9)}</a></div>" for _ in range(rng.randint(2, 6))) + "</div>"
        foot = f'<div data-y="0" class="{rng.choice(["ft", "site-footer-links", "legal-line"])}"><p>&copy; {say(2, 8)} <a href=z>{say(1, 2)}</a> <a href=w>{say(1, 2)}</a></p></div>'
        body = f'<div data-y="1" class="{rng.choice(["story-text", "articlebody", "post", "txt"])}"><div><div>{article()}</div></div></div>'
        main = f"<table><tr><td>{side}</td><td>{body}</td></tr></table>" if rng.random() < 0.3 else f"<div>{side}{body}</div>" if rng.random() < 0.5 else body + side
        yield f'<html><head><title>{say(2, 5)}</title></head><body data-y="0">{top}{main}{foot}</body></html>'


def test_accuracy_on_another_grammar(model):
    """Share of characters judged rightly on pages built in another way than the training pages."""
    right = total = 0
    for page in other_pages(200, 5):
        labels = html_extract.Dom(page, labels=True).labels
        dom = html_extract.Dom(re.sub(r' data-y="\d"', "", page))
        keep = [p > 0.5 for p in model.marginals(dom)]
        for i, text in dom.pieces:
            if text and not dom.hidden[i]:
                right += len(text) * (keep[i] == bool(labels[i]))
                total += len(text)
    assert right / total > 0.9


def test_markup_as_browsers_read_it(model):
    long = "and more text to read here, which goes on for a while so that it looks like a paragraph"
    cases = {
        f"<p>{long} <a title=it's>link and</a> then it's <a title=that's href=x>over</a> there</p>": f"{long} link and then it's over there",
        f"<p>{long} <a title='a > b' data-x=\"c > d\">link</a></p>": f"{long} link",
        f"<p>{long}<svg><path d=x /><text>mark</text></svg> goes on</p><p>{long}</p>": f"{long}mark goes on\n{long}",
        f"<p>{long}</p><svg><p>{long}</p>": f"{long}\n{long}",
        f"<p>The area is <math><mn>3</mn><mo>+</mo><mi>x</mi><annotation>3+x</annotation></math> square metres {long}</p>": f"The area is 3+x square metres {long}",
        f"<p>{long}</p><noscript><p>{long}</p></noscript><template><p>no</p></template><p>{long}</p>": f"{long}\n{long}",
        f"<p>{long}</p><iframe src=x><p>{long}</p>": f"{long}\n{long}",
        f"<p>{long}</span></div></i> goes on</p>": f"{long} goes on",
        f"<p>{long}</p><script/>var a = '<p>no</p>'</script><p>{long}</p>": f"{long}\n{long}",
        f"<p>{long}</p><p class=x/y id='>'>{long}": f"{long}\n{long}",
    }
    for page, want in cases.items():
        assert model.extract(f"<html><body><article>{page}</article></body></html>") == want, page


def test_stray_end_tags_cost_no_walk():
    def took(n):
        page = "<div>" * n + "</span></b></section>x" * n
        start = time.perf_counter()
        html_extract.Dom(page)
        return time.perf_counter() - start

    took(500)
    assert took(16_000) < 30 * max(took(2_000), 0.005)


def test_odd_pages(spark, model):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p"), (3, "u", "<!-- x"), (3, "u", "<b>" * 3000 + "deep"), (4, "u", f"<article>{'<p>word</p>' * 5000}</article>")], "page_id long, url string, html string")
    got = html_extract.extract(pages, model).collect()
    assert len(got) == 6 and {r["id"]: r["n_chars"] for r in got}[1] == 0
    assert [r["n_chars"] for r in got if r["id"] == 4] == [5000 * 5 - 1]
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    assert html_extract.extract(pages.limit(0), model).count() == 0


def test_references(model):
    assert model.extract("<article><p>a &amp; b &lt;c&gt; &eacute;&#33; and more text to read here</p></article>") == "a & b <c> é! and more text to read here"


def test_url_rules(spark):
    cases = {
        "http://a.com/en/x": ("a.com", "/en/x", "com/en/", "block"), "https://Example.COM/en/77?q": ("example.com", "/en/77", "example.com/en/7", "allow"),
        "http://example.com/en/6": ("example.com", "/en/6", "com/en/", "block"), "http://x.example.net/de/81#f": ("x.example.net", "/de/81", "example.net/de/8", "block"),
        "http://x.net/fr/1": ("x.net", "/fr/1", None, "allow"), "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "block"), "no scheme": ("", "", None, "allow"),
        "http://www.bad.org/p/?q#x": ("www.bad.org", "/p/", None, "block"), "ftp://bad.org/p": ("bad.org", "/p", None, "block"), "http://org/es/": ("org", "/es/", "org/es/", "block"), "http://": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*cases, None])], "page_id long, url string")
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), (None,), *[(f"h{k}.org/",) for k in range(500)]], "canon string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, listed, queries.URL_RULES).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    assert got[len(cases)] == ("", "", None, "allow")
    assert urls.judge(pages, listed.limit(0), queries.URL_RULES).where("listed").count() == 0
    assert urls.judge(pages.limit(0), listed, queries.URL_RULES).count() == 0


def test_the_exact_join_removes_what_a_full_filter_lets_through(spark):
    """A filter of one block for 500 keys lets nearly every row through; columns named like the filter's own stay."""
    pages = spark.createDataFrame([(k, f"p{k}.org/", k, -k, "a") for k in range(400)], "page_id long, canon string, block int, w0 int, maybe string")
    listed = spark.createDataFrame([(f"p{k}.org/",) for k in range(0, 50)] + [(f"q{k}.net/",) for k in range(450)], "canon string")
    key = F.xxhash64("canon")
    passed = bloom.marked(pages, key, listed, key, "flag", blocks=1).where("flag").count()
    assert passed > 100
    got = urls.listed_hits(pages, listed, blocks=1)
    assert got.columns == [*pages.columns, "listed"]
    assert sorted(tuple(r) for r in got.collect()) == [(k, f"p{k}.org/", k, -k, "a", k < 50) for k in range(400)]


def test_clashing_columns_and_long_values(spark, model):
    rows = [(1, "http://a.com/en/" + "x" * 100_000, "<article><p>some words to read</p></article>"), (1, "", ""), (None, None, None), (1, "http://a.com/en/" + "x" * 100_000, "<article><p>some words to read</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "'t' as text", "2 as n_chars", "'h' as host", "'p' as path", "'c' as canon", "true as listed", "'r' as rule", "3 as maybe", "4 as hit", "5 as block")
    got = sorted((r["id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract(pages, model).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "some words to read", 18), (1, "some words to read", 18)]
    listed = spark.createDataFrame([("a.com/en/" + "x" * 100_000,)], "canon string")
    found = sorted((r["id"] or 0, r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in urls.judge(pages, listed, [("allow", "net", "/de/")]).collect())
    assert found == [(0, "", 0, None, "allow"), (1, "", 0, None, "allow"), (1, "a.com", 100_004, None, "block"), (1, "a.com", 100_004, None, "block")]


def test_extraction_by_enumeration(model):
    """Small pages read by the standard parser, all assignments of content and boilerplate weighed, and the text put
    together from the likely elements, against the extractor."""
    import itertools
    import math
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tags, self.parents, self.pieces, self.open = ["html"], [-1], [], [0]

        def handle_starttag(self, tag, attrs):
            if tag not in ("a", "b", "em"):
                self.pieces.append((0, None))
            self.tags.append(tag)
            self.parents.append(self.open[-1])
            self.open.append(len(self.tags) - 1)

        def handle_endtag(self, tag):
            if tag not in ("a", "b", "em"):
                self.pieces.append((0, None))
            self.open.pop()

        def handle_data(self, data):
            self.pieces.append((self.open[-1], data))

    rng = random.Random(21)

    def element(depth):
        tag = rng.choice(["div", "section", "nav", "ul", "article"] if depth else ["p", "p", "h2", "li", "b", "a"])
        name = rng.choice(["", "", ' class="menu"', ' id="content"', " class='ad box'"])
        inside = "".join(element(depth - 1) for _ in range(rng.randint(1, 2))) if depth else " ".join("word" for _ in range(rng.randint(1, 30))) + rng.choice(["", " &amp; more", "\n text"])
        return f"<{tag}{name}>{inside}</{tag}>"

    seen_text = 0
    for _ in range(40):
        page = "".join(element(rng.randint(1, 2)) for _ in range(2))
        tree, dom = Tree(), html_extract.Dom(page)
        tree.feed(page)
        assert (dom.tags, dom.parents) == (tree.tags, tree.parents)
        seen, n = html_extract.evidence(dom), len(tree.tags)
        if n > 13:
            continue
        kids = [tree.parents.count(p) for p in range(n)]
        odds = []
        for i, (kind, what) in enumerate(seen):
            shared = html_extract.SIBLINGS / max(html_extract.SIBLINGS, kids[tree.parents[i]] if i else 1)
            odds.append(sum(model.emit.get(html_extract._event(kind, s), 0.0) * (shared if model._weight(html_extract._event(kind, s)) < 1 else 1) for s in what))
        total, content = 0.0, [0.0] * n
        for ys in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(o * y for o, y in zip(odds, ys, strict=True)) + sum(model.pair.get(seen[i][0], model.any_pair)[ys[tree.parents[i]]][ys[i]] for i in range(1, n)))
            total += w
            content = [c + w * y for c, y in zip(content, ys, strict=True)]
        blocks, held = [], []
        for i, data in [*tree.pieces, (0, None)]:
            if data is None:
                blocks.append(re.sub(r"\s+", " ", "".join(held)).strip())
                held = []
            elif content[i] / total > 0.5:
                held.append(data)
        want = "\n".join(b for b in blocks if b)
        assert model.extract(page) == want
        seen_text += bool(want)
    assert seen_text > 10
