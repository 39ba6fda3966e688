from itertools import product

import numpy as np
import pyarrow.parquet as pq
import pytest

from helpers import SF
from riskweir.llm import pagetext
from riskweir.llm.dom import parse
from riskweir.llm.labelled_pages import labelled_pages
from riskweir.llm.queries import op13_html_extraction

TEXT = "The quick brown fox jumps over the lazy dog near the river bank. "


def runs(html):
    return [t for t in parse(html).text if t]


@pytest.mark.parametrize("html, want", [
    ("plain text", ["plain text"]), ("<p>a<p>b", ["a", "b"]), ("<div><p>x</div>y", ["x", "y"]), ("", []), ("<!-- open", []), ("<a href='x", []),
    ("<p title=it's>hello</p> <P CLASS=X>z", ["hello", "z"]), ("a &amp b &am c &notit; &#x41;&nbsp;d", ["a & b &am c ¬it; A d"]), ("1 < 2 <3 > <>", ["1 < 2 <3 > <>"]),
    ("<script>x='</p>'</script>a<style>p{}</style>", ["a"]), ("<script>open", []), ("<svg><text>no</text></svg>yes", ["yes"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("<p>one<br>two <b>thr</b>ee</p>", ["one two three"]), ("<title>t</title><body>x</body>y", ["xy"]),
    ("<div>a<div>b</div>c</div>", ["a", "b", "c"]), ("</p></div>a</span>", ["a"]), ("<select><option>a</select>b<button>c</button>", ["b"]), ("\n a \t b\n", ["a b"]),
])
def test_runs(html, want):
    assert runs(html) == want


def test_parsing_is_linear():
    for page in ("<div>" * 20_000 + "x", "<p>" * 50_000, "<a \"" * 50_000, "<" * 200_000, "&" * 200_000, "<b>" * 50_000 + "y", "<div class='a" * 30_000):
        parse(page)


def small_graph(html):
    g = pagetext.graph([parse(html)])
    rng = np.random.default_rng(3)
    return g, pagetext.Model(rng.normal(size=pagetext.NODES), rng.normal(size=(pagetext.EDGES, 4)))


@pytest.mark.parametrize("html", ["<div><p>a</p><p>b <a>c</a></p></div>d", "<ul>" + "<li>x" * 3 + "</ul>", "x"])
def test_messages_give_the_exact_marginals(html):
    g, model = small_graph(html)
    node, edge = pagetext._potentials(g, model)
    n, total = len(node), 0.0
    one, both = np.zeros(n), np.zeros((n, 2, 2))
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(node[k] * y[k] for k in range(n)) + sum(edge[k, y[p], y[k]] for k, p in enumerate(g.parent) if p >= 0))
        total += w
        one += w * np.array(y)
        for k, p in enumerate(g.parent):
            if p >= 0:
                both[k, y[p], y[k]] += w
    p, joint = pagetext.marginals(g, model)
    assert np.allclose(p, one / total)
    children = g.parent >= 0
    assert np.allclose(joint[children], both[children] / total)


def test_gradient_of_the_likelihood():
    """Against differences of the log-likelihood, whose normaliser is summed over all states."""
    trees = [parse('<div><p data-main="1">a</p><p>b</p></div>')]
    g = pagetext.graph(trees)
    y = pagetext._observed(g, trees)
    _, model = small_graph("x")

    def likelihood(m):
        node, edge = pagetext._potentials(g, m)
        weight = lambda s: sum(node[k] * s[k] for k in range(len(node))) + sum(edge[k, int(s[p]), int(s[k])] for k, p in enumerate(g.parent) if p >= 0)
        return weight(y) - np.logaddexp.reduce([weight(s) for s in product((0, 1), repeat=len(node))])

    node, edge = pagetext.gradient(g, y, model)
    for slot in np.unique(g.features):
        near = pagetext.Model(model.node.copy(), model.edge)
        near.node[slot] += 1e-5
        assert np.isclose((likelihood(near) - likelihood(model)) / 1e-5, node[slot], atol=1e-3)
    for slot in np.unique(g.edges[1:]):
        near = pagetext.Model(model.node, model.edge.copy())
        near.edge[slot, 3] += 1e-5
        assert np.isclose((likelihood(near) - likelihood(model)) / 1e-5, edge[slot, 3], atol=1e-3)


def test_long_lists_are_grouped():
    tree = parse("<div>" + "<p>x</p>" * 1000 + "</div>")
    g = pagetext.graph([tree])
    assert np.bincount(g.parent[g.parent >= 0]).max() <= pagetext.FEW
    assert len(g.parent) > len(tree.parent) and sorted(np.concatenate(g.levels)) == list(range(len(g.parent)))


def exact(tree, got):
    want = pagetext.labels(tree)
    return "\n".join(t for k, t in enumerate(tree.text) if t and want[k]) == got


def test_held_out_layouts():
    """Of pages with other seeds nine in ten come out whole and exact; some of them can't be told by anything that they say."""
    trees = [parse(p) for p in labelled_pages(300, 12345)]
    texts = pagetext.main_text(trees, pagetext.standard_model())
    assert sum(map(exact, trees, texts)) >= 0.88 * len(trees)


PAGES = {
    "article": f"<body><nav><a href=/>Home</a></nav><article><h1>KEEP</h1><p>KEEP {TEXT}</p><aside><p>{TEXT}</p></aside><div class=advert>Buy</div><p>KEEP ok</p></article><footer>© x</footer></body>",
    "no element of its own": f"<body><nav><a href=/>Home</a></nav><h1>KEEP</h1><p>KEEP {TEXT * 4}</p><p>KEEP {TEXT * 2}</p><footer>© 2020 Foo</footer></body>",
    "classes": f"<body><div class=sidebar><h4>About</h4><p>{TEXT}</p></div><div class=main><h1>KEEP</h1><p>KEEP {TEXT}</p></div><div class=banner-ad><p>{TEXT}</p></div><div id=footer><p>{TEXT}</p></div></body>",
    "notice": f"<body><div class=cookie-notice>We use cookies {TEXT}</div><main><p>KEEP {TEXT}</p><ul><li>KEEP one</li><li>KEEP two</li></ul></main></body>",
    "form": f"<body><article><h1>KEEP</h1><p>KEEP {TEXT}</p><form><p>Get our newsletter every week</p><input><button>Go</button></form><p>KEEP {TEXT}</p></article></body>",
    "comments": f"<body><article><p>KEEP {TEXT}</p></article><section id=comments><h3>Comments</h3><div><b>Bob</b><p>{TEXT}</p></div></section></body>",
    "many short lines": f"<body><nav><a href=/>Home</a></nav><article><h1>KEEP</h1><p>KEEP {TEXT}</p>{'<p>KEEP it.</p>' * 800}</article><footer>© x</footer></body>",
    "nothing": "<body><nav><a href=/>Home</a></nav><article></article><footer>© x</footer></body>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    tree = parse(PAGES[name])
    want = "\n".join(t for t in tree.text if t and t.startswith("KEEP"))
    assert pagetext.main_text([tree], pagetext.standard_model()) == [want]


def test_every_page_of_the_table(spark):
    """The article's runs in page order, by an independent reading of the table's own layout."""
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op13_html_extraction(spark, SF).collect()}
    for row in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        tree = parse(row["html"])
        inside = {tree.tag.index("article")}
        for k, up in enumerate(tree.parent):
            if up in inside:
                inside.add(k)
        want = "\n".join(t for k, t in enumerate(tree.text) if t and k in inside)
        assert got[row["page_id"]] == (want, len(want))


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", ""), (3, "u", "<p>"), (4, "u", "<div>" * 3000 + "x" + "</div>" * 3000), (5, None, "a" * 300_000), (5, None, "a" * 300_000), (6, "u", "\x00<\x00p>&#0;퟿")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = pagetext.extract(df.selectExpr("*", "'clash' as text", "7 as n_chars").repartition(3)).collect()
    assert len(got) == 7 and sorted(r["n_chars"] for r in got if r["page_id"] in (1, 3)) == [0, 0]
    assert all(len(r["text"]) == r["n_chars"] for r in got)
    assert pagetext.extract(df.limit(0)).count() == 0
