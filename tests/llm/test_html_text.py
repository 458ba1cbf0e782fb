import math
import random
import time

from lithos.llm.html_text import articles, html_text, in_order, main_text, tree

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="site-header">Site Name</div><nav><ul><li><a href="/a">Menu</a><li><a href="/b">More</a></ul></nav><!-- ad -->
<div class="ad">Buy this now, buy it today, buy it for ever.</div><div id="main"><div class="content has-sidebar"><h1>The Title</h1>
<p>First long paragraph of text about things,   and more
things to be said here.<p>Second <b>par</b>agraph is <a href=x>linked</a> here and goes on for some time as well.
<p>AT&amp;T &lt;b&gt; third one&nbsp;ends.<br>After a break.</p><blockquote>Quoted text that stands within the article.</blockquote></div>
<div class="comments"><p>A reader says this in a very long comment with many words to say about the thing at hand.</p></div></div>
<aside>Side bar</aside><form><label>Name</label><textarea>x</textarea></form><div class="cookie-notice">We use cookies</div><footer>Foot</footer></body></html>"""
TEXT = "The Title First long paragraph of text about things, and more things to be said here. Second paragraph is linked here and goes on for some time as well. AT&T <b> third one ends. After a break. Quoted text that stands within the article."


def test_article():
    assert main_text(PAGE) == TEXT


def test_edges():
    assert main_text("") == "" and main_text("<p></p>") == "" and main_text("plain text") == "plain text"
    assert main_text("<p>one<p>two") == "one two"
    assert main_text('<p class="x"">a<p>b <a href="u>c</a>') == "a b c"
    assert main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert main_text('<div class="sidebar">only this</div>') == "only this"


def test_hard_pages_are_fast():
    start = time.time()
    for page in ("<div>" * 50_000 + "x", '<a="' * 50_000, "<p>x<b>" * 50_000, "</p>" * 50_000, "<!--" * 50_000):
        main_text(page)
    assert time.time() - start < 20


def test_table(spark):
    rows = [(1, "u", PAGE, "old"), (2, None, None, "old"), (None, "u", "", "old"), (1, "u", PAGE, "old")]
    found = html_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted(((r.page_id, r.text) for r in found.collect()), key=repr) == sorted([(1, TEXT), (2, ""), (None, ""), (1, TEXT)], key=repr)
    assert html_text(found.limit(0)).collect() == []


STORY = "".join(f"<p>Paragraph {i} of the story says something plain, at some length, about its subject.</p>" for i in range(4))
TOLD = " ".join(f"Paragraph {i} of the story says something plain, at some length, about its subject." for i in range(4))


def test_names_around_an_article():
    stray = "<div>Stray line</div>"
    for page in (
        f"{stray}<div class='content-sidebar-wrap'>{STORY}</div>",
        f"{stray}<div class='elementor-widget'>{STORY}</div>",
        f"{stray}<div class='sidebar'><article>{STORY}</article></div>",
        f"{stray}<div id='modal'><main>{STORY}</main></div>",
        f"{stray}<div class='widget'>{STORY}</div>",
        f"<form id='aspnetForm'>{STORY}</form>",
        f"<form>{STORY.replace('<p>', '<div>').replace('</p>', '</div>')}</form>",
    ):
        assert TOLD in main_text(page), page
    assert "Earlier" in main_text(f"<article>{STORY}<section id='related-work'><h2 id='social-impact'>Earlier</h2>{STORY}</section></article>")


def test_long_comments_stay_out():
    assert main_text(f"<article>{STORY}</article><div class='comment-list'>{STORY.replace('story', 'reader') * 3}</div>") == TOLD


def test_self_closed_drawing():
    assert main_text(f"<svg class='x > y' width=\"1\" />{STORY}") == TOLD and main_text(f"<p>a<math/>b</p><svg><text>no</text></svg>{STORY}").startswith("ab ")


def test_raw_and_drawn_elements():
    for page in (f"<iframe src='x'/>{STORY}", f"<script src='x'/>{STORY}", f"<object>no<object>no</object>no</object>{STORY}", f"<select><option>no<option>no</select>{STORY}", f"<!-->{STORY}", f"<svg><g>no</g>{'</svg>'}{STORY}"):
        assert main_text(page) == TOLD, page
    assert main_text(f"{STORY}<script>never closed {STORY}") == TOLD


def test_inline_elements_are_nodes():
    page = STORY.replace("plain,", "<span class='ad'>Buy!</span>pl<em>ai</em>n,<span hidden>unseen</span>")
    assert main_text(f"<article>{page}</article>") == TOLD


def test_names_that_say_nothing():
    """Links, a line of an advert and a footer, all in plain boxes: density alone tells them from the article."""
    links = "".join(f"<li><a href='/{i}'>Place {i}</a></li>" for i in range(6))
    page = f"<div><ul>{links}</ul></div><div>Buy this now, buy it for ever.</div><div><h1>A title of the story</h1>{STORY}</div><div>Some host and some sentence at the foot.</div>"
    assert main_text(page) == f"A title of the story {TOLD}"
    parts = "<div><div>{0}</div><div><ul>{1}</ul></div><div>{0}</div></div>".format(STORY, links)
    assert main_text(parts) == f"{TOLD} {TOLD}"


def brute(root):
    """Densities and sums of a tree (tag, parts), the node with the largest sum and the threshold on its path, straight from
    their definitions."""
    def below(x):
        return [y for p in x[1] if not isinstance(p, str) for y in (p, *below(p))]

    def chars(x):
        return sum(len(p) if isinstance(p, str) else chars(p) for p in x[1])

    def linked(x):
        return chars(x) if x[0] == "a" else sum(linked(p) for p in x[1] if not isinstance(p, str))

    def density(x):
        c, t, lc, lt = chars(x), len(below(x)), linked(x), sum(y[0] == "a" for y in below(x))
        if not c:
            return 0.0
        base = max(math.log(1 + math.e), math.log(lc * c / max(1, c - lc) + linked(root) / max(1, chars(root)) * c + math.e))
        return max(0.0, c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, lt), base))

    total = lambda x: sum(density(p) for p in x[1] if not isinstance(p, str) and p[0] in ("div", "p"))
    every = [root, *below(root)]
    main = max(every, key=lambda x: round(total(x), 6))
    path = [x for x in every if x is main or any(y is main for y in below(x))]
    return [(x[0], density(x), total(x)) for x in every], chars(main), total(main), min(map(density, path))


def grown(r, depth):
    tag = r.choice(["div", "div", "p", "b", "a"]) if depth else "body"
    kinds = {"body": "div p", "div": "div p b a", "p": "b a", "b": "", "a": ""}[tag].split()
    parts = [r.choice(["word", "x" * r.randint(1, 60)])]
    for _ in range(r.randint(0, 4) if depth < 5 else 0):
        child = grown(r, depth + 1)
        if child[0] in kinds:
            parts += [child, r.choice(["yz", "w" * r.randint(1, 30)])]
    return tag, parts


def test_densities_against_brute_force():
    r = random.Random(3)
    show = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(show, x[1]))}</{x[0]}>"
    for _ in range(300):
        root = grown(r, 0)
        expected, chars, total, threshold = brute(root)
        page = tree("".join(map(show, root[1])))
        found = articles(page)
        nodes = in_order(page)
        assert [n.tag for n in nodes] == [x[0] for x in expected]
        for n, (_, d, t) in zip(nodes, expected):
            assert math.isclose(n.density, d, abs_tol=1e-9) and math.isclose(n.total, t, abs_tol=1e-9)
        top = max(nodes, key=lambda n: round(n.total, 6))
        assert top.chars == chars and math.isclose(top.total, total) and any(n is top for n in found)
        for n in found:
            assert n is top or max(m.total for m in in_order(n)) >= threshold - 1e-9 or n.tag == "p" and n.density >= threshold - 1e-9


def test_hard_nests_are_fast():
    start = time.time()
    for page in ("<b>" * 50_000 + "<p>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<header>" * 50_000, "<p><button>" + "<i>" * 50_000 + "<hr>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000):
        main_text(page)
    assert time.time() - start < 40
