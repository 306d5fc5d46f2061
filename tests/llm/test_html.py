import pytest

from gridmark.llm.html_text import extract_text, main_text

LONG = "This is a paragraph of some length, with words enough to be taken for text."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy!</div><article><h1>Head &amp; more</h1><p>{LONG}</p><p>To.</p></article><footer>&copy; x</footer>", f"Head & more\n\n{LONG}\n\nTo."),
        (f"<article><h1>H</h1><p><b>{LONG}<br><p>Two\n  words &nbsp; here</article><footer>f", f"H\n\n{LONG}\n\nTwo words here"),
        (f"<header><h1>Site</h1></header><main><header><h1>Story</h1></header><p>{LONG}</p><aside>No</aside><form><input value=x>No</form><p>End.</p></main>", f"Story\n\n{LONG}\n\nEnd."),
        (f"<div id=wrap><div class=content><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</div><div class='sidebar'><a href=1>One</a></div><div id='comments'><p>{LONG}</p></div></div>", f"Head\n\n{LONG}\n\nShort.\n\n{LONG}"),
        (f"<article><p>{LONG}</p><article class='comment'><p>{LONG} No</p></article></article>", LONG),
        (f"<div class='cookie-notice'>{LONG}</div><p>{LONG} Yes</p>", f"{LONG} Yes"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul></article>", "a\n\nb\n\nc\n\nx\n\ny"),
        (f"<div role=navigation><p>{LONG}</p></div><article hidden></article><article><p>{LONG} 2</p></article>", f"{LONG} 2"),
    ],
)
def test_main_text(body, expected):
    assert main_text(page(body)) == expected


SHORT, FULL = f"{LONG} {LONG}", " ".join([LONG] * 7)
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Go {k}</a></li>" for k in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<div class=post><h1>Head</h1><p>{SHORT}</p><p>{FULL}</p><p>{SHORT}</p></div>", ["Head", SHORT, FULL, SHORT]),
        (f"<div class=post><h1>Head</h1><p>{SHORT}</p><blockquote><p>{FULL}</p><p>{FULL}</p></blockquote></div>", ["Head", SHORT, FULL, FULL]),
        (f"<div id=post><section><h2>A</h2><p>{FULL}</p><p>{FULL}</p></section><div class=ad>Buy</div><section><h2>B</h2><p>{FULL}</p></section></div>{LINKS}", ["A", FULL, FULL, "B", FULL]),
        (f"<section><p>{FULL}</p><p>{FULL}</p></section><section><p>{FULL}</p></section>", [FULL, FULL, FULL]),
        (f"<div id=post><div><p>{FULL}</p><p>{FULL}</p></div><div><p>{SHORT}</p></div></div>", [FULL, FULL, SHORT]),
    ],
)
def test_region_of_one_dominant_part(body, expected):
    assert main_text(page(body)) == "\n\n".join(expected)


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<div id=story><h1>Head</h1><p>{FULL}</p><p>{FULL}</p></div>{LINKS}<article><p>{SHORT} card</p></article>", ["Head", FULL, FULL]),
        (f"<div id=story><h1>Head</h1><p>{FULL}</p><p>{FULL}</p></div><article><p>{SHORT} card</p></article>", ["Head", FULL, FULL]),
        (f"<div id=all><article><h2>1</h2><p>{FULL}</p></article><article><p>{FULL} b</p></article><article><p>{SHORT}</p></article></div>", ["1", FULL, f"{FULL} b", SHORT]),
        (f"<div><article><p>{FULL}</p></article></div><div><article><p>{FULL} b</p></article></div>", [FULL, f"{FULL} b"]),
        (f"<main><p>{SHORT} card</p></main><div id=story><p>{FULL}</p><p>{FULL}</p></div>", [f"{SHORT} card", FULL, FULL]),
    ],
)
def test_articles_win_by_their_text(body, expected):
    assert main_text(page(body)) == "\n\n".join(expected)


@pytest.mark.parametrize("html", ["", None, "<", "<!-- a", "<p", "</p></div>", "<script>x", "<nav>only</nav>", "&", "<article></article>"])
def test_broken_pages(html):
    assert isinstance(main_text(html), str)


def test_long_page():
    assert main_text("<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(5000))).count("\n\n") == 4999


def test_query(spark):
    rows = [(1, "u", page(f"<article><p>{LONG} é</p></article>")), (2, None, None), (None, "v", ""), (1, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_text(pages).collect())
    assert found == [(0, "", 0), (1, f"{LONG} é", len(LONG) + 2), (1, "x", 1), (2, "", 0)]
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body,expected",
    [
        (f"<article><h1 class='header'>Head</h1><p>{FULL}</p></article>", ["Head", FULL]),
        (f"<article><div class='header'><h1 class='social'>Head</h1></div><div class='social-history'><p>{FULL}</p></div><div class='social'>Like us</div><p class=notice>By reading</p></article>", ["Head", FULL]),
        (f"<main><p>{FULL}</p><div class='related-posts'><a href=/1>{LONG}</a></div><ul class='comment-list'><li>{LONG}</ul></main>", [FULL]),
        (f"<div class='header'>Site</div><div><p>{FULL}</p><p>{SHORT}</p></div>", [FULL, SHORT]),
        (f"<p>{FULL}</p><!-- never closed > <p>{SHORT}</p>", [FULL, SHORT]),
        (f"<p>{FULL}</p><p>{SHORT} <b", [FULL, SHORT]),
        (f"<![if x]><p>{FULL}</p><![CDATA[ no ]]><p>{SHORT}</p>", [FULL, SHORT]),
    ],
)
def test_names_and_broken_markup(body, expected):
    assert main_text(body) == "\n\n".join(expected)


@pytest.mark.parametrize("piece", ['<a b="', "<a ", "<!--", "<a/", "<div><p>x", "<span>x", "</b>", "<b><div>x", "<span></b>", "<section>x", "<![CDATA["])
@pytest.mark.parametrize("end", ["", '">'])
def test_broken_pages_take_time_in_proportion(piece, end):
    import time

    began = time.process_time()
    main_text("<p>Hello.</p>" + piece * (300_000 // len(piece)) + end)
    assert time.process_time() - began < 20  # hours, if it grew with the square


def test_two_megabytes_of_open_tags():
    import time

    began = time.process_time()
    assert main_text('<a b="' * 333_333) == ""
    assert time.process_time() - began < 1


def plain_main_text(html):
    """The same rules by regular expressions, for pages whose elements are all closed and whose story is one article."""
    import re

    html = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>", "", html, flags=re.S)
    story = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    for tag in ("script", "style", "nav", "aside", "form", "footer"):
        story = re.sub(rf"<{tag}\b.*?</{tag}>", "", story, flags=re.S)
    story = re.sub(r"<div class=\"ad\">.*?</div>", "", story, flags=re.S)
    blocks = re.split(r"</?(?:p|div|h[1-6]|ul|ol|li|article|section)\b[^>]*>", story)
    texts = (" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def test_against_a_plain_version():
    import random

    rng = random.Random(11)
    word = lambda: rng.choice(["story", "caf&eacute;", "<b>bold</b>", "a&amp;b", "x&#8212;y", "line<br>break", "<a href='/q'>link</a>"])
    text = lambda n: " ".join(word() for _ in range(n))
    for _ in range(60):
        parts = [f"<h1>{text(4)}</h1>"]
        for _ in range(rng.randint(1, 9)):
            parts.append(rng.choice([f"<p>{text(rng.randint(1, 60))}</p>", f"<section><h2>{text(3)}</h2><p>{text(40)}</p></section>", f"<ul><li>{text(9)}</li><li>{text(2)}</li></ul>", '<div class="ad">Buy now</div>', "<aside><p>No</p></aside>", "<script>var x = '<p>';</script>", "<!-- <p>no</p> -->"]))
        parts.append(f"<p>{text(50)}</p>")
        html = page(f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article>{''.join(parts)}</article><div class=comments><p>{text(30)}</p></div><footer>f</footer>")
        assert main_text(html) == plain_main_text(html)
