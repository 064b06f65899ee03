import itertools
import math
import random

from chainlens.llm import html_extract as H
from llm_util import prose

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad -->'
        '<div class="ad">Buy this now.</div><article><h1>{h}</h1>{b}</article>'
        '<footer>&copy; site &middot; About us.</footer></body></html>')


def pages(spark, extra=()):
    rng = random.Random(29)
    rows = [(i, f"http://x/{i}", PAGE.format(h=prose(rng, lines=1, words=5), b="".join(
        f"<p>{x}" for x in prose(rng, lines=5).split("\n"))), 1) for i in range(60)]
    return spark.createDataFrame(rows + list(extra), "page_id long, url string, html string, text int")


def test_articles_and_defined_cases(spark):
    cases = {
        100: (None, ""), 101: ("", ""), 102: ("<nav><a href=x>only a menu</a></nav>", ""),
        103: (PAGE.format(h="A &amp; B &eacute; &#233; &amp", b="<p><b>One  two\n three.</b><br><p>Four <i>fi</i>ve."),
              "A & B é é &\nOne two three.\nFour five."),
        104: (PAGE.format(h="H", b="<p>Text.</p><div class='comments'><p>First! Great post.</p></div><form><p>Name"
                                   "<input></form><aside>See also</aside>"), "H\nText."),
        105: (PAGE.format(h="H", b="<p>" + "long text here. " * 20_000)[:-60], "H\n" + ("long text here. " * 20_000).strip()),
        106: (PAGE.format(h="H", b="<ul><li>a item<li>b item</ul><table><tr><td>x cell<td>y cell</table>"),
              "H\na item\nb item\nx cell\ny cell"),
        107: ("<p>unclosed <b>tags <div class=\"sidebar\">x</div", None),
    }
    df = pages(spark, [(i, None, h, 2) for i, (h, _) in cases.items()] + [(103, None, cases[103][0], 2)])
    model = H.train(df)
    out = H.extracted(df, model)
    assert out.columns == ["page_id", "url", "text"] and out.count() == df.count()
    for r in out.where("page_id >= 100").collect():
        if cases[r["page_id"]][1] is not None:
            assert r["text"] == cases[r["page_id"]][1], r["page_id"]


def test_unmarked_layout_is_judged_by_the_model(spark):
    model = H.train(pages(spark))
    rng = random.Random(31)
    body = prose(rng, lines=6).split("\n")
    html = ("<body><div id='top-menu'><a href=1>Home</a> <a href=2>News</a></div><div class='post'>"
            + "".join(f"<p>{x}</p>" for x in body) + "</div><div class='cookie-notice'>We use cookies.</div></body>")
    assert "cookies" not in model.extract(html) and "Home" not in model.extract(html)


MENU = "<ul>" + "".join(f"<li><a href=/{w}>{w}</a></li>" for w in ("Home", "News", "Sport", "About us")) + "</ul>"


def layouts(rng):
    """Pages that don't mark their article: name -> (html, main text)."""
    title, *body = prose(rng, lines=7, words=16).split("\n")
    title = " ".join(title.split()[:5]).rstrip(".")
    paras = "".join(f"<p>{x}</p>" for x in body)
    text = "\n".join([title, *body])
    links = "".join(f"<a href=/{i}>{w}</a> " for i, w in enumerate(("Home", "News", "Sport")))
    rows = "".join(f"<tr><td><a href=/{w}>{w}</a></td></tr>" for w in ("Home", "News", "Sport"))
    return {
        "post": (f"<body><div id=top>{links}</div><div class=post><h1>{title}</h1>{paras}</div></body>", text),
        "bare body": (f"<body><h1>{title}</h1>{paras}</body>", text),
        "no body": (f"<h1>{title}</h1>{paras}", text),
        "menu": (f"<body>{MENU}<h2>{title}</h2>{paras}{MENU}</body>", text),
        "deep": ("<body>" + "<div>" * 30 + f"<h1>{title}</h1>{paras}" + "</div>" * 30 + "</body>", text),
        "layout table": (f"<body><table><tr><td><table>{rows}</table></td><td><h1>{title}</h1>{paras}</td></tr></table></body>", text),
        "divs": (f"<body>{MENU}<div><h1>{title}</h1>" + "".join(f"<div>{x}</div>" for x in body) + "</div></body>", text),
        "inline": (f"<body>{MENU}<div><h1>{title}</h1>" + paras.replace("<p>", "<p><b>").replace("</p>", "</b></p>") + "</div></body>", text),
        "unclosed": (f"<body>{MENU}<h1>{title}</h1><p>" + "<p>".join(body), text),
        "attributes": (f"<body>{MENU}<h1 title=it's>{title}</h1>" + "".join(
            f"<p title=it's data-id=\"comments\" alt='a > b'>{x}</p>" for x in body) + "</body>", text),
    }


def test_pages_that_do_not_mark_their_article(spark):
    model = H.train(pages(spark))
    blind = H.PlainModel(model.counts, markers=False)
    for seed in range(5):
        for name, (html, want) in layouts(random.Random(seed)).items():
            assert model.extract(html) == want, (seed, name)
            model.plain, kept = blind, model.plain       # the marker words are not needed
            assert model.extract(html) == want, (seed, name, "without markers")
            model.plain = kept
    html, want = layouts(random.Random(5))["post"]
    notice = html.replace("</body>", "<div class='cookie-notice'><p>We use cookies. You agree.</p></div>"
                                     "<footer><p>All rights are reserved.</p></footer></body>")
    assert model.extract(notice) == want


def test_attributes():
    def names(html):
        return [(x.tag, x.names, x.text) for x in H.parse(html)[1:]]
    assert names("<p title=it's>a</p><p title='it'>b") == [("p", (), ""), ("#text", (), "a"), ("p", (), ""), ("#text", (), "b")]
    assert names('<p title="open>a') == [("p", (), ""), ("#text", (), "a")]
    assert names("<p data-id='ad' title='class=ad' CLASS = \"mainText\" id=x'y role>a>b") == [
        ("p", ("main", "text", "x", "y"), ""), ("#text", (), "a>b")]
    assert names("<a href=/x/>in</a>out<p title='a>b\">c") == [
        ("a", (), ""), ("#text", (), "in"), ("#text", (), "out"), ("p", (), ""), ("#text", (), 'b">c')]
    assert names("<p a=b\">c</p>" + "<p x='" * 3) [:2] == [("p", (), ""), ("#text", (), "c")]


def test_statistics_are_of_a_fixed_number():
    from collections import Counter
    counts = Counter()
    for i in range(300):
        H.count_page("<article>" + "".join(f"<x{i}-{j} class='{chr(97 + i % 26) * 3}{chr(97 + j)}{chr(97 + i // 26)}'>t</x{i}-{j}>"
                                           for j in range(20)) + "</article>", counts)
    assert len(counts) < 2 * (H.NAMES + 64) + 200
    assert len([k for k in counts if k.startswith("f\ttag")]) <= 2 * 66


def brute_marginals(model, nodes):
    """Sum over all states of the tree."""
    n = len(nodes)
    unary = model.potentials(nodes)
    total, on = 0.0, [0.0] * n
    for s in itertools.product((0, 1), repeat=n):
        e = unary[0] * s[0] + sum(unary[k] * s[k] + model.edge[H._kind(nodes[k])][s[nodes[k].parent]][s[k]] for k in range(1, n))
        w = math.exp(e)
        total += w
        for k in range(n):
            on[k] += w * s[k]
    return [x / total for x in on]


def test_messages_give_exact_marginals(spark):
    found = H.train(pages(spark))
    for model, html in itertools.product((found.marked, found.plain), ("<div><p>One two three.</p><a href=x>link</a><div class='ad'>Buy</div></div>",
                 "<article><h1>T</h1><p>a <b>b</b> c</p></article><nav><a>x</a></nav>", "text only")):
        nodes = H.parse(html)
        H.measure(nodes)
        want, got = brute_marginals(model, nodes), model.marginals(nodes)
        assert all(abs(a - b) < 1e-9 for a, b in list(zip(want, got))[1:])


def test_empty(spark):
    df = pages(spark).where("false")
    assert H.extracted(df, H.train(df)).count() == 0
