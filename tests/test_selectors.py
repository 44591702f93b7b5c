"""Selectors over hand-made pages, against what they find by eye."""

import pytest

from pagewright.functions import selectors
from pagewright.operators import extract

PAGE = (
    "<html lang=en-GB><body><nav id=top><ul class='menu main'><li class=on><a href='/x/1'>One</a></li><li><a href='/y/2' rel='nofollow'>Two</a></li><li><a href='x3'> Three <b>bold</b></a></li></ul></nav>"
    "<main><h2>A</h2><p>first</p><p class='lead big'>second  one</p><div data-k='v-1'><p>deep</p><span>s</span></div><h2>B</h2><p>third</p></main>"
    "<img src=a.png><img src=b.png alt=''><p></p></body></html>"
)


@pytest.fixture(scope="module")
def find(spark):
    pages = extract.parse(spark.createDataFrame([(1, PAGE)], "page_id long, html string").selectExpr("*", "html AS raw"))
    pages = pages.cache()

    def run(kind, query, result="text", attribute=None, **more):
        return extract.custom_extractions(pages, [extract.Search("q", kind, query, result, attribute)], body="raw", **more).first()

    return run


@pytest.mark.parametrize("query, found", [
    ("ul > li a[href^=x]", ["Three bold"]), ("ul>li>a[href^='/x']", ["One"]), ("li", ["One", "Two", "Three bold"]), ("nav a[rel]", ["Two"]), ("#top a[href$='2']", ["Two"]),
    ("ul.main.menu > li.on", ["One"]), ("h2 + p", ["first", "third"]), ("h2 ~ p", ["first", "second  one", "third"]), ("main p", ["first", "second  one", "deep", "third"]),
    ("main > p.lead", ["second  one"]), ("li:nth-child(2)", ["Two"]), ("li:last-child", ["Three bold"]), ("main > p:nth-of-type(3)", ["third"]), ("main p:first-of-type", ["first", "deep"]),
    ("li:not(.on)", ["Two", "Three bold"]), ("b, h2, #none", ["bold", "A", "B"]), ("*[data-k|=v]", ["deeps"]), ("p:not([class]):first-child", ["deep"]), ("[class~=big]", ["second  one"]),
    ("body * span", ["s"]), ("h2 + div", []), ("P.lead", ["second  one"]), ("[href*='']", []),
])
def test_css(find, query, found):
    row = find("css", query)
    assert (row.error, row["values"]) == (None, found)


@pytest.mark.parametrize("query, found", [
    ("//ul/li/a", ["One", "Two", "Three bold"]), ("//nav//a[@rel]/text()", ["Two"]), ("//li[2]/a/@href", ["/y/2"]), ("//li[last()]/a/@href", ["x3"]), ("/html/body/main/p[position()=2]", ["second  one"]),
    ("//a[contains(@href,'/')]/@href", ["/x/1", "/y/2"]), ("//a[starts-with(@href,'/') and @rel='nofollow']", ["Two"]), ("//p[text()='deep']", ["deep"]), ("//p[normalize-space(.)='second one']", ["second  one"]),
    ("//p[contains(., 'ir')]", ["first", "third"]), ("//li[not(@class)]", ["Two", "Three bold"]), ("//a[@rel!='me']", ["Two"]), (".//div/*", ["deep", "s"]), ("//html/@lang", ["en-GB"]),
])
def test_xpath(find, query, found):
    row = find("xpath", query)
    assert (row.error, row["values"]) == (None, found)


@pytest.mark.parametrize("kind, query", [
    ("css", "ul >"), ("css", "> li"), ("css", "a[href"), ("css", "a:hover"), ("css", ""), ("css", "a,,b"), ("css", "a > > b"), ("css", "li:nth-child(0)"), ("css", "a!"),
    ("xpath", "li"), ("xpath", "//li/parent::ul"), ("xpath", "//li[position()>1]"), ("xpath", "//"), ("xpath", "//li[text()='a' and @b]"), ("xpath", "//a[1]x[2]"), ("regex", "(a"), ("jsonpath", "$.a"),
])
def test_a_bad_query_is_an_error_row(find, kind, query):
    row = find(kind, query)
    assert row.error and row["values"] == [] and not row.truncated


def test_results_and_bounds(find):
    assert find("css", "img", "attribute", "alt")["values"] == []  # blank and absent ones aren't values
    assert find("css", "img", "attribute", "src")["values"] == ["a.png", "b.png"]
    row = find("css", "main p", most=2, longest=3)
    assert (row["values"], row.truncated) == (["fir", "sec"], True)
    assert find("regex", r"href='(/\w)")["values"] == ["/x", "/y"]
    assert find("regex", r"<h2>\w")["values"] == ["<h2>A", "<h2>B"]
    assert find("css", "a", "html").error


def test_one_bad_search_leaves_the_others(spark):
    pages = extract.parse(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string"))
    rows = extract.custom_extractions(pages, [extract.Search("a", "css", "h2"), extract.Search("b", "css", "h2["), extract.Search("c", "regex", "x")]).collect()
    assert len(rows) == 9
    assert {(r.page_id, r.id): (r["values"], bool(r.error)) for r in rows if r.page_id == 1} == {(1, "a"): (["A", "B"], False), (1, "b"): ([], True), (1, "c"): ([], True)}
    assert all(r["values"] == [] for r in rows if r.page_id > 1)


def test_steps_are_read():
    path = selectors.css("a > b.c")[0]
    assert [(s.before, s.tag) for s in path.steps] == [(" ", "a"), (">", "b")]
