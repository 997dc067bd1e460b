"""HTML extraction: block splitting, and main text of known and of other layouts."""

import random

import pytest

from vigil.llm import htmlblocks as hb


def texts(page):
    return [b.text for b in hb.blocks(page)]


def test_blocks():
    assert texts("") == [] and texts("plain  text\n here") == ["plain text here"]
    assert texts("<p>a <b>b</b>c<br>d<p>e &amp; &#233;&lt;i&gt;</p>") == ["a bc", "d", "e & é<i>"]
    assert texts("<script>var t='</p>';</script >x<style>p{}</style><!-- no <p> -->y<!DOCTYPE z>") == ["x" + "y"]
    assert texts("<p title='a > b'>in</p><p>3 < 4 & 5</p><script>never closed <p>x") == ["in", "3 < 4 & 5"]
    assert texts("<ul><li>one<li>two</ul></div></p>after") == ["one", "two", "after"]
    assert len(texts("<div>" * 50000 + "deep" + "</div>" * 50000)) == 1
    (b,) = hb.blocks("<div class='site-Nav main'><a href=x>go</a> on</div>")
    assert {"div", "site", "nav", "main"} <= b.path and b.links == 2


def page(rng, before="<nav><ul><li><a href='/a'>Home</a></li></ul></nav><div class=\"ad\">Buy this now.</div>", main="article",
         after="<footer>&copy; someone</footer>"):
    body = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 60))) + "." for _ in range(rng.randrange(2, 7))]
    inner = "".join(f"<p>{x}</p>" for x in body)
    name = main.split()[0]
    return f"<html><head><title>T</title></head><body>{before}<{main}><h1>{body[0][:20].strip()}</h1>{inner}</{name}>{after}</body></html>", \
        " ".join([body[0][:20].strip(), *body])


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(1)
    rows = [(i, page(rng)[0]) for i in range(60)] + [(99, None), (100, "")]
    return hb.train(spark.createDataFrame(rows, "page_id bigint, html string"))


def test_known_layout(spark, net):
    rng = random.Random(2)
    rows = [page(rng) for _ in range(40)]
    df = spark.createDataFrame([(i % 30, "u", h, "old") for i, (h, _) in enumerate(rows)] + [(None, None, None, None), (7, "u", "", "x")],
                               "page_id bigint, url string, html string, text string")
    got = hb.extract(df, net).collect()
    assert sorted((r["html"], r["text"]) for r in got if r["html"]) == sorted(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and sum(r["text"] == "" for r in got) == 2
    assert hb.extract(df.limit(0), net).count() == 0


def test_other_layouts(net):
    rng = random.Random(3)
    other = [("main", "<div class='cookie-notice'>We use cookies here.</div><header><a href=x>Home</a></header>", "<section class=comments><p>I liked this text very much, thanks.</p></section>"),
             ("div class='post-content'", "<form class=search>Search</form><aside class=sidebar><p>Related things to read</p></aside>", "<div id=comments><p>So wrong.</p></div><footer>legal</footer>"),
             ("section id='story'", "<div class=menu><a href=x>A</a> <a href=y>B</a></div>", "<div class='newsletter signup'><p>Subscribe to us</p></div>")]
    right = total = 0
    for main, before, after in other:
        for _ in range(15):
            h, want = page(rng, before, main, after)
            own = hb.blocks(h)
            got = hb.label(net, [own], hb.Features())[0]
            for b, m in zip(own, got):
                right += (b.text in want) == bool(m)
                total += 1
    assert right / total >= 0.9


@pytest.mark.parametrize("cut", ["<a " * 350_000, "<p>text</p><a " + "x=\"y\" " * 100_000, "<p>text</p><a " + "x='y\" " * 100_000 + "b=\"", "<script>" + "</script " * 120_000,
                                 "<" * 1_000_000, "<a b='" * 170_000, "<a b=\"'>" * 120_000, "<!--" * 250_000, "<p class=" + "class='" * 140_000])
def test_cut_pages_take_linear_time(cut):
    import time

    t0 = time.time()
    hb.blocks(cut)
    assert time.time() - t0 < 5


def test_quotes_and_cut_tags():
    assert texts("<p>a</p><a href=\"x>y\" title='>'>b</a>") == ["a", "b"]
    assert texts("<p title=\"never closed>a<p>b") == ["a", "b"]
    assert texts("<p>a</p><a href=\"cut off") == ["a", "<a href=\"cut off"]
    assert texts("it's <b x=1>bold</b> isn't it") == ["it's bold isn't it"]


def test_long_pages_by_windows(net, monkeypatch):
    rng = random.Random(4)
    own = hb.blocks("".join(page(rng)[0] for _ in range(30)))
    whole = hb.label(net, [own], hb.Features())[0]
    monkeypatch.setattr(hb, "WINDOW", 37)
    assert (hb.label(net, [own], hb.Features())[0] == whole).all() and 0 < whole.sum() < len(own)


def test_sample_of_repeated_pages(spark):
    rng = random.Random(5)
    same = page(rng)[0]
    rows = [(1, same)] * 300 + [(i, page(rng)[0]) for i in range(5)]
    net = hb.train(spark.createDataFrame(rows, "page_id bigint, html string"), max_pages=6, epochs=1)
    assert net.wx.shape[0] == 2
