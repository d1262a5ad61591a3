"""Articles of several divisions: all of their blocks are kept, on hosts of one page and of many."""

import pytest

from glyphline.llm import html_extract

HEAD, FOOT = "<div><a href=/a>Home</a> <a href=/b>News of the site</a></div>", "<div>Copyright of the site owners, all rights</div>"


def _para(name, i, k):
    return " ".join(f"{name}{i}k{k}w{j}" for j in range(25))


def _blocks(name, i, n):
    return [_para(name, i, k) for k in range(n)]


#: Markup of an article of some blocks.
LAYOUTS = {
    "siblings": lambda i, b: f"<div><p>{b[0]}</p></div><a href=/n{i}>next</a><div><p>{b[1]}</p><p>{b[2]}</p></div>",
    "sections": lambda i, b: "".join(f"<section><p>{x}</p></section>" for x in b),
    "lead": lambda i, b: f'<article><div class="lead"><p>{b[0]}</p></div><div class="body">{b[1]}<p>{b[2]}</p></div></article>',
    "table": lambda i, b: f"<article><table><tr><td>{b[0]}</td><td>{b[1]}</td></tr></table><p>{b[2]}</p></article>",
    "main": lambda i, b: f'<main><div class="lead"><p>{b[0]}</p></div><div class="body">{b[1]}<p>{b[2]}</p></div></main>',
    "wrapped": lambda i, b: f'<div class="wrap"><div class="lead"><p>{b[0]}</p></div><div class="body">{b[1]}<p>{b[2]}</p></div></div>',
    "seldom": lambda i, b: f"<article><div><p>{b[0]}</p></div>" + (f"<table><tr><td>{b[1]}</td></tr></table>" if i == 3 else f"<p>{b[1]}</p>") + f"<div>{b[2]}</div></article>",
}


@pytest.mark.parametrize("pages", [1, 12])
def test_no_block_is_lost(spark, pages):
    rows, want = [], {}
    for n, (name, layout) in enumerate(LAYOUTS.items()):
        for i in range(pages):
            blocks = _blocks(name, i, 3)
            rows.append((100 * n + i, f"http://{name}.example/{i}", f"<html><body>{HEAD}{layout(i, blocks)}{FOOT}</body></html>"))
            want[100 * n + i] = name, blocks
    out = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    for r in out.collect():
        name, blocks = want[r.page_id]
        got = [x for x in r.text.split("\n") if x != "next"]
        if pages > 1 or name in ("lead", "table", "main", "seldom"):  # a page alone without an article says nothing of its menus
            assert got == blocks, (name, r.text)
        else:
            assert [x for x in got if x in blocks] == blocks, (name, r.text)


def test_order_of_pages_has_no_influence(spark):
    rows = [(i, f"http://one.example/{i}", f"<html><body>{HEAD}{LAYOUTS['sections'](i, _blocks('s', i, 3))}{FOOT}</body></html>") for i in range(30)]
    seen = []
    for parts, some in ((1, rows), (5, rows[::-1])):
        table = spark.createDataFrame(some, "page_id long, url string, html string").repartition(parts)
        seen.append(sorted(map(tuple, html_extract.extract_text(table, block=8).collect())))
    assert seen[0] == seen[1] and all(r[2].count("\n") == 2 for r in seen[0])


def test_very_long_urls(spark):
    odd = "a\U0001f600" * 50_000
    page = f"<html><body>{HEAD}<article><p>{_para('x', 1, 1)}</p></article>{FOOT}</body></html>"
    table = spark.createDataFrame([(1, odd, page), (2, f"http://{odd}/", page), (3, None, page)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_text(table).collect()} == dict.fromkeys((1, 2, 3), _para("x", 1, 1))
