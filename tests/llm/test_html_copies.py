"""Copies of a page are one example of their host's wrapper."""

from logloom.llm import html_extraction

PAGE = "<html><head><title>t</title></head><body><div>{0}<p>The only paragraph of article {1} stands here.</p></div><h4>Share this site</h4></body></html>"
QUOTE = "<h2>A heading that only this page has</h2>"


def texts(spark, pages):
    frame = spark.createDataFrame([(i, f"http://h.example.com/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extraction.extract_main_text(frame).collect()}


def test_three_equal_pages(spark):
    got = texts(spark, ["<html><body><div><p>One paragraph is the article.</p></div></body></html>"] * 3)
    assert set(got.values()) == {"One paragraph is the article."}


def test_copies_beside_other_pages(spark):
    pages = [PAGE.format("", k) for k in range(6)] + [PAGE.format(QUOTE, 6)] * 4
    got = texts(spark, pages)
    assert all(got[k] == f"The only paragraph of article {k} stands here." for k in range(6))
    assert all(got[k] == "A heading that only this page has\n\nThe only paragraph of article 6 stands here." for k in range(6, 10))
