"""Pages in a frame: each rule on a page, and properties over all kinds of pages."""

import re
from urllib.parse import quote

import pytest

from skein.sources.reframe import reframe, reframed

SITE, URL = "https://reader.example", "https://blog.example.com/posts/a-post.html"
FRAME = f"{SITE}/api/frame?u="


def page(body, head=""):
    return f"<!doctype html><html><head><title>A Post</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("body,head,want", [
    ('<a href="https://x.example/docs?a=1&amp;b=2">d</a>', "", f'<a href="{FRAME}{quote("https://x.example/docs?a=1&b=2", safe="")}">d</a>'),
    ('<a href="../other.html">o</a>', "", f'<a href="{FRAME}https%3A%2F%2Fblog.example.com%2Fother.html">o</a>'),
    ('<img src="/hero.jpg"><a name=x>n</a>', '<link rel="stylesheet" href="/site.css">', '<link rel="stylesheet" href="/site.css"></head><body><img src="/hero.jpg"><a name=x>n</a>'),
    ("x", "", f'<base href="{URL}"><title>'),
    ('<a href="deep.html">d</a>', '<base href="/wiki/">', '<base href="https://blog.example.com/wiki/">'),
    ('<a href="deep.html">d</a>', '<base href="/wiki/">', f'"{FRAME}https%3A%2F%2Fblog.example.com%2Fwiki%2Fdeep.html"'),
    ('<a href="#notes">n</a>', "", f'href="{FRAME}{quote(URL, safe="")}#notes"'),
    ('<a href="https://e.example/x" target="_blank" rel="me">o</a>', "", '<a href="https://e.example/x" target="_blank" rel="me noopener">'),
    ('<a href="/home" target="_top">h</a>', "", 'target="_self"'),
    ('<a href="mailto:a@b.org">m</a>', "", '<a href="mailto:a@b.org" target="_blank">'),
    ('<a href="javascript:void(0)">j</a><a href="ftp://a.example/">f</a>', "", '<a href="javascript:void(0)">j</a><a href="ftp://a.example/">f</a>'),
    ('<form action="/search"><input name=q></form><form></form>', "", f'<form action="https://blog.example.com/search" target="_blank"><input name=q></form><form action="{URL}" target="_blank"></form>'),
    ("x", '<meta http-equiv="Refresh" content="0; url=/new">', f'content="0;url={FRAME}https%3A%2F%2Fblog.example.com%2Fnew"'),
    ("<script>if (a<b && c>'</a>') {}</script>&copy;&#169; &amp b<!-- <a href=x> -->", "", "<script>if (a<b && c>'</a>') {}</script>&copy;&#169; &amp b<!-- <a href=x> -->"),
])
def test_rules(body, head, want):
    assert want in reframe(page(body, head), URL, SITE)


def test_what_goes_and_where_it_is_announced():
    out = reframe(page("x", '<meta http-equiv="Content-Security-Policy" content="default-src none"><meta charset="utf-8">'), URL, SITE)
    assert "Security" not in out and '<meta charset="utf-8">' in out
    assert out.startswith('<!doctype html><html><head><script>try{parent.postMessage({"source":"reader","url":"' + URL)
    assert [reframe(t, URL, SITE) for t in (None, "", "  ")] == [None, "", "  "]
    assert reframe("<p>bare", URL, SITE).startswith("<!doctype html>\n<head><script>") and reframe("<html><body>x", URL, SITE).startswith("<!doctype html>\n<html><head><script>")


def test_pages_have_no_relative_link_left(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = pages.select("url", "html", reframed(pages.html, pages.url, SITE).alias("out")).collect()
    assert rows and all(len(r.out) > len(r.html) for r in rows if r.html)
    for r in rows:
        for tag in re.findall(r"(?is)<a\b[^>]*>", re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "", r.out or "")):
            href = re.search(r'href="([^"]*)"', tag)
            assert not href or re.match(r"[A-Za-z][A-Za-z\d+.-]*:|$", href[1]), tag
        bodies = lambda t: re.findall(r"(?is)<script\b[^>]*>(.*?)</script>", t or "")
        assert bodies(r.out)[-len(bodies(r.html)) :] == bodies(r.html) or not bodies(r.html)
