"""Pages as they are: unclosed and stray tags, attributes in any form, raw text, comments."""

import pytest
from pyspark.sql import functions as F

from feedloom.functions import markup, text
from feedloom.sources import fetch, html

TIME = '<time datetime="2026-01-0{0}T18:00:00-06:00">x</time>'
CARD = "<div class=meeting-card-compact><h3 class='meeting-week'>Week {0}</h3>{1}" + TIME + "</div>"


@pytest.mark.parametrize("unclosed", ["", "<p>one", "<ul><li>one<li>two", "<table><tr><td>one<tr><td>two", "<span><b>", "<p><em>one", "</p></span></li>", "<dl><dt>a<dd>b", "<select><option>a<option>b", "<br></br>", "<p/><img src=x>", "<!-- </div> -->", "<p title='</div>'>"])
def test_no_card_is_lost(spark, unclosed):
    body = "<main>" + "".join(CARD.format(k, unclosed) for k in range(1, 5)) + "</main>"
    got = html.cards(spark.createDataFrame([("k", body)], "source_key string, body string")).collect()
    assert [(r.pos, r.week, r.datetime) for r in got] == [(k - 1, f"Week {k}", f"2026-01-0{k}T18:00:00-06:00") for k in range(1, 5)]


def test_a_card_that_never_ends_keeps_those_within_it(spark):
    body = "".join(CARD.format(k, "").removesuffix("</div>") for k in (1, 2, 3))
    got = html.cards(spark.createDataFrame([("k", body)], "source_key string, body string")).collect()
    assert [r.week for r in got] == ["Week 1", "Week 2", "Week 3"]


def test_stray_end_tags_end_nothing_outside_their_block(spark):
    body = "<div class=meeting-card-compact></b></table></section><h3 class=meeting-week>A</i></h3><p class=meeting-location>Hall<br></p>" + TIME.format(1) + "</div>"
    (got,) = html.cards(spark.createDataFrame([("k", body)], "source_key string, body string")).collect()
    assert (got.week, got.place, got.has_time) == ("A", "Hall", True)


def test_links_in_all_forms(spark):
    page = """<a href="/a?x=1&amp;y=2">1</a><A HREF='/b'>2</A><a class=x href=/c>3</a><a title="a>b" href = "/d">4</a><a href="/a?x=1&amp;y=2">5</a><a>6</a>
    <!-- <a href="/no"> --><script>"<a href='/no'>"</script><textarea><a href=/no></textarea><abbr href=/no>x</abbr><a href>7</a>"""
    got = html.links(spark.createDataFrame([(1, page), (2, None), (3, "<a href='/z'")], "k int, body string"), "k", "body").collect()
    assert sorted((r.k, r.href, r.pos) for r in got) == [(1, "", 6), (1, "/a?x=1&amp;y=2", 1), (1, "/b", 2), (1, "/c", 3), (1, "/d", 4)]


@pytest.mark.parametrize("link", ["<a href='/events/details/a-b/'>", "<a href=/events/details/a-b/>", '<a href="/events/details/a-b/">', "<a data-x='>' href='https://e.org/events/details/a-b/?q=1&amp;r=2'>"])
def test_the_crawl_finds_links_in_all_forms(link):
    site = {"https://e.org/c/": f"<p>{link}go</a>", "https://e.org/events/details/a-b/": "page"}
    got = list(fetch.crawl("https://e.org/c/", lambda url: (200, site[url].encode()), lambda _: None))
    assert got == [("https://e.org/events/details/a-b/", "page", None)]


@pytest.mark.parametrize("page,want", [
    ('<p title="a>b">Hello</p>', "Hello"), ("<p title='<b>'>Hello<p>Bye", "Hello"), ("<p>1 < 2 & 3 &lt; 4", "1 < 2 & 3 < 4"), ("<!-- <p>no</p> --><p>yes", "yes"), ("<!--><p>yes", "yes"), ("<?php x ?><!DOCTYPE html><p>yes", "yes"),
    ("<p>yes<!-- open", "yes"), ("<p>yes<b class='", "yes"), ("a<br>b", "a"), ("</p>stray", "stray"), ("<p>caf&eacute;&nbsp;x", "café x"), ("x</ >y<p>z", "xy"),
])
def test_excerpts_of_odd_pages(spark, page, want):
    assert spark.createDataFrame([(page,)], "c string").select(text.excerpt(F.col("c"))).first()[0] == want


def test_a_script_is_one_paragraph(spark):
    page = '<p></p><script>var a = "</p>more &amp;";</script><p>Text</p>'
    got = spark.createDataFrame([(page,)], "c string").select(text.html_paragraphs(F.col("c"))).first()[0]
    assert got == ['var a = "</p>more &amp;";', "Text"]


def test_linked_data_with_any_quotes(spark):
    body = """<link href=https://e.org/x/ rel='a Canonical'><SCRIPT type='application/ld+json'>{"@type": "Event", "name": "a </b> & b"}</SCRIPT><script>{"@type": "Event"}</script>"""
    got = html.linked_events(spark.createDataFrame([("k", body)], "source_key string, body string")).first()
    assert got.canonical == "https://e.org/x/" and got.event.name == "a </b> & b"


def test_tokens_never_loop():
    for page in ["<", "</", "<a", "<a b", "<a b=", "<a b='", '<a b="x', "<!", "<!--", "<a/b/>", "<a =x>", "<a b=c d>", "<script", "<script>", "<script></scrip", "<a ' \" >", "&", ""]:
        list(markup.tokens(page))
        markup.Outline().walk(page * 3)
    assert list(markup.tokens("<a =x b= c>"))[0][2] == [("=x", None), ("b", "c")]
