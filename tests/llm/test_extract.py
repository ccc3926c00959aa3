import random

import pytest

from geoweave.llm import extract

WORD = ["river", "stone", "market", "under", "told", "they", "a", "of", "quiet", "seven"]


def words(r, n):
    return " ".join(r.choice(WORD) for _ in range(n))


def page(layout, seed):
    """(html, its main text) in one of some layouts that the labelled table does not hold word by word."""
    r = random.Random(seed)
    body = [words(r, r.choice([1, 4, 12, 30, 80])) for _ in range(r.randrange(3, 9))]
    body[1] = words(r, 45)
    title, links = words(r, 7), "".join(f"<li><a href='/{i}'>{words(r, 1)}</a></li>" for i in range(5))
    note, reader, foot = words(r, 11), words(r, 25), words(r, 9)
    if layout == "semantic":
        paras = "".join(f"<p>{b}</p>" for b in body)
        text = (f"<html><head><title>{title}</title><style>p{{}}</style></head><body><header><p>{note}</p></header><nav><ul>{links}</ul></nav><main><h1>{title}</h1>{paras}<form><label>{note}</label></form>"
                f"<section id='comments'><p>{reader}</p></section></main><aside><p>{note}</p></aside><footer>{foot}</footer></body></html>")
        return text, "\n".join([title, *body])
    if layout == "classes":
        paras = "".join(f"<div class='par'>{b}<span> &amp; more</span></div>" for b in body)
        text = (f"<body class='has-sidebar'><div id='cookieConsent'>{note}</div><div id=topNav><ul>{links}</ul></div><div class='blog-post'><h2>{title}</h2>{paras}<div class='adSlot'>{reader}</div></div>"
                f"<div class='right sidebar'><p>{reader}<p>{note}</div><div id='footer'>{foot}</div>")
        return text, "\n".join([title, *(b + " & more" for b in body)])
    paras = "".join(f"<p>{b}\n" for b in body)  # nothing is named, nothing is closed
    return f"<ul>{links}</ul><script>if (a<b) document.write('<p>no</p>')</script><h1>{title}</h1>{paras}", "\n".join([title, *body])


@pytest.mark.parametrize("layout", ["semantic", "classes", "bare"])
def test_held_out_layouts(layout):
    tree = extract.trained_tree()
    made = [page(layout, s) for s in range(60)]
    right = sum(extract.main_text(h, tree) == t for h, t in made)
    assert right >= (54 if layout == "bare" else 60), right


def test_blocks_and_references():
    got = extract.flat_blocks("<div>a&nbsp;&lt;b&gt;<!-- c --><i>d</i>e\n f<br>g<br> <br>h<p>i <a href=\"x>y\">j k</a> l</div>m<script>n</script>o <p title=unclosed")
    assert [b[0] for b in got] == ["a <b>de f g", "h", "i j k l", "mo"]
    assert [b[2] for b in got] == [0, 0, 2, 0]
    for broken in ("<", "<!", "<!--", "<p", "<p title='", "</", "<script>", "&#xD800;&#0;", "a < b", "<a" * 50000, "<!--" * 50000, "<p>" * 50000):
        extract.flat_blocks(broken)


def test_table_with_messy_rows(spark):
    long = "<article>" + "".join(f"<p>paragraph number {i} of a long page" for i in range(40000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>some words of text"), (3, "v", long), (3, "v", long), (4, "w", "<nav><a>x</a></nav>")]
    more = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted((tuple(r) for r in extract.extract_pages(more, most_bytes=1000).collect()), key=str)
    want = "\n".join(f"paragraph number {i} of a long page" for i in range(40000))
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "some words of text", 18), (3, "v", want, len(want)), (3, "v", want, len(want)), (4, "w", "", 0)], key=str)
    assert extract.extract_pages(more.limit(0)).count() == 0


def test_tree_separates_the_labelled_table():
    x, y = extract.labelled_features()
    tree = extract.trained_tree()
    assert len(y) < 200 and sum(extract.decide(tree, r) == bool(v) for r, v in zip(x, y)) >= 0.99 * len(y)
