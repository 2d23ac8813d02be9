"""Page text: what holds it, runs across blocks, copies on a host."""

import pytest

from marketspark.llm import html_text

ARTICLE = "<article><h1>T</h1><p>body</p></article>"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<form><div>side</div>{ARTICLE}</form>", ["T", "body"]),
        ("<form><p>a whole page in a form</p></form><p>c 2024</p>", ["a whole page in a form", "c 2024"]),
        ("<p>more words than the form</p><form>Log in</form>", ["more words than the form"]),
        (f"<div class='content no-sidebar'>{ARTICLE}</div>", ["T", "body"]),
        ("<div class='no-sidebar nav-fixed'><p>a b</p></div>", ["a b"]),
        (f"<div class='page share'>{ARTICLE}</div>", ["T", "body"]),
        ("<article><div class='post-header'><h1>T</h1></div><p>b</p><div class='share'>s</div></article>", ["T", "b"]),
        ("<main>m</main><div class='comments'><article>c</article></div><form><article>d</article></form>", ["m"]),
        ("<p>one <span class='ad'>buy</span> two</p><div class='cookie-banner'>c</div>", ["one two"]),
        (f"<nav>{ARTICLE}</nav><div hidden>{ARTICLE}</div>", []),
    ],
)
def test_what_holds_a_text(html, text):
    assert [t for _, t in html_text.blocks_of(html)] == text


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_menu_of_one_word_blocks_goes(spark):
    menu = "".join(f"<li>{w}</li>" for w in "Home News Sport Travel Shop Help Jobs Login".split())
    rows = [(i, f"http://h/{i}", f"<ul>{menu}</ul><p>{own} words stand here</p><p>Short {own}</p>") for i, own in enumerate(("some", "other", "more"))]
    rows.append((9, "http://else/", f"<ul>{menu}</ul>"))
    got = texts(spark, rows)
    assert [got[i] for i in range(3)] == [f"{own} words stand here\nShort {own}" for own in ("some", "other", "more")]
    assert got[9] == "Home\nNews\nSport\nTravel\nShop\nHelp\nJobs\nLogin"


def test_copies_and_quotes_are_no_furniture(spark):
    body = "a whole article of more than eight words that stands twice"
    menu = "see our shop and our news and our jobs"
    quote = "to be or not to be that is the question"
    rows = [(1, "http://c/1", f"<p>{body}</p>"), (2, "http://c/2", f"<p>{body}</p>")]  # equal contents
    rows += [(3, "http://d/1", f"<p>{body}</p>"), (4, "http://d/2", f"<p>{body}</p><p>on sale</p>")]  # one is nothing but the run
    rows += [(i, url, f"<p>{body}</p><p>own {i}</p>") for i, url in ((5, None), (6, "http://["))]  # no host
    rows += [(10 + k, f"http://e/{k}", f"<p>{menu}</p><p>p{k} page</p>" + f"<p>{quote}</p>" * (k < 2)) for k in range(7)]
    got = texts(spark, rows)
    assert got == {
        1: body, 2: body, 3: body, 4: f"{body}\non sale", 5: f"{body}\nown 5", 6: f"{body}\nown 6",
        **{10 + k: f"p{k} page" + f"\n{quote}" * (k < 2) for k in range(7)},
    }


def test_notices_in_articles_go_by_their_suffixes(spark):
    notice = "<p>Read more of this on our own site every day</p><p>Sign up now</p>"
    quote = "to be or not to be that is the question"
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    page = lambda k, more: f"<nav>menu</nav><article><h1>Title {k}</h1><p>{words(k, 30)} {quote}</p>{more}<p>{words(k, 5)} {quote} end</p></article>"
    text = lambda k, more: f"Title {k}\n{words(k, 30)} {quote}\n{more}{words(k, 5)} {quote} end"
    rows = [(k, f"http://a/{k}", page(k, notice if k < 4 else "")) for k in range(5)]
    rows += [(5, "http://a/5", page(0, notice))]  # equal contents are one page
    rows += [(10 + k, f"http://two/{k}", page(k, notice)) for k in range(2)]  # too few pages
    rows += [(20 + k, f"http://some/{k}", page(k, notice if k < 3 else "")) for k in range(6)]  # no more than half
    body = f"<p>{words(9, 60)}</p>"
    rows += [(30 + k, f"http://copies/{k}", f"<article><p>copy {k}</p>{body}</article>") for k in range(4)]
    rows += [(40 + k, None, page(k, notice)) for k in range(4)]
    got = texts(spark, rows)
    shown = "Read more of this on our own site every day\nSign up now\n"
    assert [got[k] for k in range(6)] == [text(k % 5, "") for k in range(6)]
    assert [got[10 + k] for k in range(2)] == [text(k, shown) for k in range(2)]
    assert [got[20 + k] for k in range(6)] == [text(k, shown if k < 3 else "") for k in range(6)]
    assert [got[30 + k] for k in range(4)] == [f"copy {k}\n{words(9, 60)}" for k in range(4)]
    assert [got[40 + k] for k in range(4)] == [text(k, shown) for k in range(4)]
