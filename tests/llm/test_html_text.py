import html as references
import random
import re

import pytest
from pyspark.sql import functions as F

from blockweave.llm import html_text
from tests.conftest import DATA

P = "Enough words in this paragraph to make it stand out from what is around it, and then some more of them."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=/>Home</a></nav></body></html>", ""),
        ("plain text only", "plain text only"),
        (f"<article><h1>Head</h1><p>{P}<p>Of.</article><footer>Us</footer>", f"Head\n{P}\nOf."),
        (f"<div class=menu>Menu and more</div><div><h2>Head</h2><p>{P}</p><p>Of.</p></div><div id=footer>Us</div>", f"Head\n{P}\nOf."),
        (f"<form><div class='site-header'>Top</div><article><p>{P}</p><div class=ad>Buy</div><p>Two &amp; &lt;3 &am</p></article></form>", f"{P}\nTwo & <3 &am"),
        (f"<main><p>{P}<br>next  line\n\there</p><section id=comments><p>{P}</p></section></main>", f"{P} next line here"),
        (f"<article><p>{P}</p></article><article class=comment><p>First comment</p></article>", P),
        (f"<article><script>var a='<p>'</script><style>p{{}}</style><p>a<b>b</b> c<td>d</td></p><p hidden>x</p></article>", "ab c d"),
        (f"<nav><ul><li>Open and never closed<article><p>{P}</p></article>", P),
        (f"<!-- <p>no</p> --><article><aside>Side</aside><p>{P}</p><footer>Tags</footer></article>", P),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def brute_ranges(lengths, threshold, window):
    """Ranges by their definition, sums taken anew at every line."""
    n, out, i = len(lengths), [], 0
    total = lambda k: sum(lengths[k : k + window])
    while i < n:
        if lengths[i] and total(i) >= threshold:
            end = next((k for k in range(i, n) if not total(k)), n)
            last = max(k for k in range(i, end) if lengths[k])
            start = i
            while start and lengths[start - 1] and (not out or start > out[-1][1]):
                start -= 1
            out.append((start, last + 1))
            i = max(end, last + 1)
        else:
            i += 1
    return out


def test_surges_and_dives_equal_their_definition():
    rng = random.Random(1)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randint(0, 30))]
        for threshold in (1, 80):
            assert html_text.between_surges_and_dives(lengths, threshold) == brute_ranges(lengths, threshold, html_text.WINDOW)


def test_table_form_and_edges(spark):
    rows = [(1, "u", f"<p>{P}</p>"), (None, None, None), (1, "u", f"<p>{P}</p>"), (2, "v", "<article>" + f"<p>{P}</p>" * 3000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in html_text.extract_text(pages).collect()), key=repr)
    long = "\n".join([P] * 3000)
    assert got == sorted([(0, None, "", 0), (1, "u", P, len(P)), (1, "u", P, len(P)), (2, "v", long, len(long))], key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_whole_table_is_the_text_of_the_article_elements(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(references.unescape(re.sub(r"</?(?:b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    "page",
    [
        f"<p class=notice>x<p>{P}</p>",
        f"<p class=notice>x<div>{P}</div>",
        f"<ul><li class=menu-item>A<li class=menu-item>B</ul><p>{P}</p>",
        f"<ul><li class=menu-item>A<ul><li>In</ul><li class=menu-item>B</ul><article><p>{P}</article>",
        f"<table><tr><td class=ad>A<td class=ad>B<tr class=ad><td>C</table><p>{P}",
        f"<table><tr><th class=menu>A<tr><td>{P}</table>",
        f"<dl><dt class=nav>A<dd class=nav>B</dl><p>{P}",
        f"<select><option>A<option>B</select><p>{P}",
        f"<div><aside>Side</div><p>{P}</p>",
        f"<div><select><option>A</div><p>{P}</p>",
        f"<div><button>A</div><p>{P}</p>",
    ],
)
def test_optional_end_tags_end_what_is_dropped(page):
    assert html_text.main_text(page) == P


def test_end_tags_inside_do_not_end_what_is_dropped():
    assert html_text.main_text(f"<div class=ad><p>A<div>B</div></p></b></i><ul><li>C</ul></div><p>{P}</p>") == P


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<main><p>{P}</p><div class=related><article>Teaser</article></div></main>", P),
        (f"<main><p>{P}</p><article>Teaser</article></main>", P),
        (f"<p>{P}</p><section id=comments><article>Me too</article></section>", P),
        (f"<article><p>Short.</p></article><p>{P}</p><p>Us</p>", f"Short.\n{P}\nUs"),
        (f"<div class=ad>Open<article><p>{P}</p></article>", P),
    ],
)
def test_a_mark_weighs_but_does_not_replace_surges(page, text):
    assert html_text.main_text(page) == text


LINKS = "<ul>" + "".join(f"<li><a href=/{n}>Another page number {n}</a>" for n in range(4)) + "</ul>"


@pytest.mark.parametrize(
    "page,text",
    [
        # a list of links is a dive inside the article, and what follows it has to surge
        (f"<article><p>{P}</p>{LINKS}<p>Read on</p></article>", P),
        (f"<article><p>{P}</p>{LINKS}<p>{P}</p><p>End.</p></article>", f"{P}\n{P}\nEnd."),
        # fewer links, linked headlines and articles of links alone are text
        (f"<article><h1><a href=/>Head</a></h1><p>{P}</p><p><a href=/>More</a></p></article>", f"Head\n{P}\nMore"),
        ("<article><p><a href=/1>One</a></p><p><a href=/2>Two</a></p><p><a href=/3>Three</a></p></article>", "One\nTwo\nThree"),
        # beside an article that surges a teaser falls out, a long text does not
        (f"<article><p>{P}</p></article><div>{P}</div>", P),
        (f"<article><p>{P}</p></article><div>{P} {P} {P} {P}</div>", f"{P}\n{P} {P} {P} {P}"),
        # low text without a list of links before it stays
        (f"<article><p>By me</p><div class=ad>Buy</div><p>{P}</p><div class=ad>Buy</div><p>End.</p></article>", f"By me\n{P}\nEnd."),
    ],
)
def test_surges_and_dives_choose_inside_and_beside_the_article(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("part", ["<p class=ad>x</p>", "<p class=notice>x</p>", "<h2 class=share>x</h2>", "<div class=user-comments-area>x</div>",
                                  "<div class=the-newsletter-box>x</div>", "<div role=navigation>x</div>", "<div class=site-header>x</div>"])
def test_marked_parts_of_an_article_go(part):
    assert html_text.main_text(f"<article><p>{P}</p>{part}<p>{P}</p></article>") == f"{P}\n{P}"


@pytest.mark.parametrize("part", ["<div class=entry-header><h1>x</h1></div>", "<blockquote class=promo-quote>x</blockquote>", "<h1 class=share-title>x</h1>",
                                  "<p class=lead-header>x</p>", "<div class='post category-social'>x</div>", "<div class=builder-widget-text>x</div>",
                                  "<div class='box has-sidebar'>x</div>", "<div class=content-with-sidebar>x</div>"])
def test_own_parts_of_an_article_stay(part):
    assert html_text.main_text(f"<article>{part}<p>{P}</p></article>") == f"x\n{P}"


FRAMES = [  # what surrounds the text on pages that mark no article
    "<body><nav><a href=/>Home</a><a href=/a>News</a></nav>{}<footer>All rights reserved</footer></body>",
    "<div id=top-menu><ul><li><a href=/>Home</a><li><a href=/a>News</a></ul></div><div id=content>{}</div><div class=site-footer>Us</div>",
    "<table><tr><td class=sidebar>Side text that is long enough to be taken for a part of the text, were it not for its class name.<td>{}</table>",
    "<div class=header>Name of the site</div>" + LINKS + "{}" + LINKS,
    "<form><input name=q><button>Go</button></form><div>{}</div><section id=comments><p>" + P + "</p></section>",
    "<div class=cookie-consent><p>" + P + "</p></div><div><div>{}</div></div><script>var a = 1</script><aside>Side</aside>",
]
BODIES = [
    [P],
    ["Head", P],
    ["Head", P, "Of two words", P],
    [P, "Short."],
    [P] * 40,
]


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("body", BODIES)
def test_pages_that_mark_no_article(frame, body):
    blocks = "".join(f"<h2>{b}</h2>" if b == "Head" else f"<p>{b}</p>" for b in body)
    assert html_text.main_text(frame.format(blocks)) == "\n".join(body)
