"""Hand-written page set for the unit tests (a small blog)."""

from __future__ import annotations

BASE = "http://blog.test/"

LIST0 = """<!DOCTYPE html>
<html><head><title>Posts, page one</title></head><body>
<header><a href="/">Home</a> <a href="/about/">About</a>
  <a href="/tags/x"><img src="/i/tag.png" alt="tag"></a></header>
<div id="main">
  <article class="post"><div class="post-title"><h2><a href="/posts/first">First post</a></h2></div>
    <div class="post-body"><p>Short intro text.</p></div></article>
  <article class="post"><div class="post-title"><h2><a href="/posts/second">Second post</a></h2></div>
    <div class="post-body"><p>Another intro.</p></div></article>
  <article class="post"><div class="post-title"><h2><a href="/posts/third">Third post</a></h2></div>
    <div class="post-body"><p>Panicked readers wrote in.</p></div></article>
</div>
<nav class="pager"><a rel="next" href="/page/2">Older posts</a></nav>
<footer>
  <a href="/posts/first#comments"></a>
  <a href="/posts/second/">Second again</a>
  <a href="mailto:me@blog.test">Mail</a>
  <a href="javascript:void(0)">Script</a>
  <a href="https://other.test/x">Elsewhere</a>
  <a href="  /about  ">About us</a>
  <a>No href</a>
  <a href="">Empty href</a>
  <a href="?page=1">Same page</a>
  <a href="#top"></a>
  <a href="/tags/x/">Tag X</a>
</footer></body></html>"""

LIST0_LINKS = [
    ("About", "http://blog.test/about/"),
    ("Elsewhere", "https://other.test/x"),
    ("First post", "http://blog.test/posts/first"),
    ("Home", "http://blog.test/"),
    ("Older posts", "http://blog.test/page/2"),
    ("Same page", "http://blog.test/?page=1"),
    ("Second post", "http://blog.test/posts/second"),
    ("Tag X", "http://blog.test/tags/x/"),
    ("Third post", "http://blog.test/posts/third"),
]

LIST1 = """<html><head><title>Posts, page two</title></head><body><div id="main">
  <article class="post"><div class="post-title"><h2><a href="/posts/fourth">Fourth</a></h2></div></article>
  <article class="post"><div class="post-title"><h2><a href="http://blog.test/posts/fifth">Fifth</a></h2></div></article>
</div><nav><a rel="next" href="/page/3">Older</a></nav></body></html>"""


def article(title: str, body: str, alt: str = "") -> str:
    alt_attr = f' alt="{alt}"' if alt else ""
    return (
        f"<html><head><title>{title}</title></head><body><div id=\"main\"><article class=\"post\">"
        f"<div class=\"post-title\"><h2><a href=\"/posts/{title.split()[0].lower()}\">{title}</a></h2></div>"
        f"<div class=\"post-body\"{alt_attr}>{body}</div></article></div></body></html>"
    )


A0 = article(
    "First post",
    "<p>Text of the first post, long enough to count as a paragraph.</p>"
    "<img src=\"/media/one.jpg?size=2\"><p>More text, with a comma, and another.</p>",
    alt="Body one",
)
A1 = article(
    "Second post",
    "<p>Second body text, again long enough for a paragraph.</p><img src=\"/media/two.png\">"
    "<p><a href=\"/files/report.pdf\">Report</a> attached.</p>",
)
A2 = article("Third post", "<p>No picture in this one, just words and words.</p>")

PAGES = [
    (0, BASE, LIST0),
    (1, "http://blog.test/page/2", LIST1),
    (2, "http://blog.test/posts/first", A0),
    (3, "http://blog.test/posts/second", A1),
    (4, "http://blog.test/posts/third", A2),
    (5, "http://blog.test/null", None),
    (6, "http://blog.test/empty", ""),
    (7, "http://blog.test/plain", "Loose words"),
    (8, "http://blog.test/bare", "<html>"),
]

TARGET = "//div[@class='post-title']/h2/a"
EXPAND = '//a[@rel="next"]'


def pages_df(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
