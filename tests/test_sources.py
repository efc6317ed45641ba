import struct
from datetime import datetime

from skein.sources import documents as D
from skein.sources import outlines as O
from skein.sources import pages as P
from skein.sources import playlists as L

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>A&nbsp;B</title><link>https://a.example</link>
<item><title>One</title><guid>1</guid><pubDate>Mon, 03 Aug 2026 10:00:00 GMT</pubDate><content:encoded>&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;</content:encoded><enclosure url="https://x/a.mp3" type="audio/mpeg" length="12"/><itunes:duration>1:02</itunes:duration><category>Go</category><category>go</category></item>
<item><title>Two</title><link>https://a.example/2</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><link rel="self" href="s"/><link href="https://h.example"/><entry><id>urn:1</id><title>E</title><link rel="alternate" href="https://h.example/e"/><updated>2026-08-01T00:00:00Z</updated><author><name>Ann Bee</name></author><summary>x</summary></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel rdf:about="c"><title>R</title></channel><item rdf:about="https://r.example/1"><title>I</title><link>https://r.example/1</link></item></rdf:RDF>"""


def test_rss():
    f = D.parse_feed(RSS)
    one, two = f["items"]
    assert (f["format"], f["title"], f["kind"]) == ("rss", "A\xa0B", "blog")
    assert one["published_at"] == datetime(2026, 8, 3, 10) and one["summary"] == "Hi & bye"
    assert one["audio"] == {"url": "https://x/a.mp3", "type": "audio/mpeg", "bytes": 12, "seconds": 62}
    assert one["categories"] == ["Go"] and two["guid"] == "https://a.example/2" and two["published_at"] is None


def test_kinds():
    head = RSS.index("<link>https://a.example</link>")
    kind = lambda tags, body=RSS: D.parse_feed(body[:head] + tags + body[head:])["kind"]
    assert kind("<itunes:type>episodic</itunes:type>") == "podcast" and kind("<itunes:explicit>no</itunes:explicit>") == "podcast"
    video = RSS.replace("audio/mpeg", "video/mp4")
    silent = RSS.replace('<enclosure url="https://x/a.mp3" type="audio/mpeg" length="12"/>', "")
    assert kind("<itunes:explicit>no</itunes:explicit>", silent) == "blog" and kind("<itunes:type>episodic</itunes:type>", silent) == "podcast"
    assert kind("", video) == "blog" and kind("<itunes:explicit>no</itunes:explicit>", video) == "video"
    assert D.parse_feed(RSS, "https://www.youtube.com/feeds/videos.xml?x")["kind"] == "video"


def test_atom_rdf_json():
    a = D.parse_feed(ATOM)
    assert a["site_url"] == "https://h.example" and a["items"][0]["author"] == "Ann Bee" and a["items"][0]["guid"] == "urn:1"
    assert D.parse_feed(RDF)["items"][0]["guid"] == "https://r.example/1"
    j = D.parse_feed('{"title":"J","items":[{"id":1,"url":"u","tags":["a"],"attachments":[{"url":"x.mp3","mime_type":"audio/mpeg","duration_in_seconds":5}]}]}')
    assert j["items"][0]["guid"] == "1" and j["items"][0]["audio"]["seconds"] == 5
    assert D.parse_feed("{") is None and D.parse_feed("<p>no") is None and D.parse_feed(None) is None and D.parse_feed("{}") is None


def test_playlists():
    f = D.parse_feed("#EXTM3U\n#PLAYLIST:Mix\n#EXTINF:12,Artist - Song\na.mp3\n#EXTINF:-1,Track 3 - Name\nhttps://b.example/b.mp3\n", "https://x.example/p.m3u")
    assert f["title"] == "Mix" and [i["author"] for i in f["items"]] == ["Artist", None] and f["items"][0]["url"] == "https://x.example/a.mp3"
    p = D.parse_feed("[playlist]\nTitle2=B\nFile2=b.mp3\nFile1=a.mp3\nLength1=7\nTitle1=A\n")
    assert [(i["title"], i["audio"]["seconds"]) for i in p["items"]] == [("A", 7), ("B", None)]
    live, vod = "#EXTM3U\n#EXT-X-TARGETDURATION:4\n#EXTINF:4.0,\na.ts\n", "#EXTM3U\n#EXT-X-TARGETDURATION:4\n#EXTINF:4.0,\na.ts\n#EXTINF:3.5,\nb.ts\n#EXT-X-ENDLIST\n"
    assert D.parse_feed(live, "u")["kind"] == "live" and D.parse_feed(vod, "u")["items"][0]["audio"]["seconds"] == 8
    assert L.looks_like_playlist("audio/x-mpegurl", "", "") and not L.looks_like_playlist("text/html", "<html>", "a.html")


def test_opml():
    xml = '<opml><body><outline text="g"><outline text="A" xmlUrl="https://A.example/f"/><outline xmlUrl="https://a.example/f"/></outline><outline xmlUrl="https://b.example/?a=1&amp;b=2"/></body></opml>'
    assert [(o["url"], o["title"]) for o in O.parse_opml(xml)] == [("https://A.example/f", "A"), ("https://b.example/?a=1&b=2", None)]
    for k in range(1, len(xml)):
        s = O.Scanner()
        assert s.push(xml[:k]) + s.push(xml[k:]) == ["https://A.example/f", "https://a.example/f", "https://b.example/?a=1&b=2"]


def test_pages():
    posts = "".join(f'<div class="post"><h2><a href="/p{i}">A long enough title {i}</a></h2><time datetime="2026-08-0{i}"></time></div>' for i in range(1, 5))
    f = P.feed_from_page(f"<html lang='en'><title>Site</title><body><nav><div class='post'></div></nav>{posts}</body></html>", "https://s.example/")
    assert [i["url"] for i in f["items"]] == [f"https://s.example/p{i}" for i in range(1, 5)] and f["language"] == "en"
    arts = "".join(f"<article><h3>Another quite long title {i}</h3><a href='/a{i}'>go</a></article>" for i in range(3))
    assert len(P.feed_from_page(arts, "https://s.example/")["items"]) == 3
    ld = '<script type="application/ld+json">{"@graph":[' + ",".join(f'{{"@type":"BlogPosting","headline":"H{i}","url":"/l{i}"}}' for i in range(3)) + "]}</script>"
    assert P.feed_from_page(ld, "https://s.example/")["items"][2]["url"] == "https://s.example/l2"
    assert P.feed_from_page("<p>none", "u") is None and P.feed_from_page(None, "u") is None
    assert P.feed_links('<link rel="alternate" type="application/rss+xml" href="/f"><link rel=alternate type="text/html" href="/x">', "https://s.example/a") == ["https://s.example/f"]
    assert P.identities('<a rel="me" href="https://m.example/@a">x</a><meta name="author" content="Ann Bee">', "u") == {"profiles": ["https://m.example/@a"], "people": [{"name": "Ann Bee", "source": "meta", "confidence": 0.6}]}


def test_sanitize():
    assert P.sanitize('<p onclick=x>a<script>b</script><a href="javascript:1">c</a><b>d') == '<p>a<a rel="nofollow noopener" target="_blank">c</a><b>d</b></p>'
    assert P.sanitize(None) == "" and P.sanitize("a < b & c") == "a &lt; b &amp; c"


def test_image_sizes():
    assert P.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == ("png", 3, 4)
    assert P.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("gif", 5, 6)
    assert P.image_size(b"\xff\xd8\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 8) + b"\0" * 9) == ("jpeg", 8, 7)
    assert P.image_size(b"") is None and P.image_size(None) is None


def test_documents_are_parsed_once_and_by_all_cores(spark, sf):
    """A file of one row group is dealt to as many tasks as a shuffle has before Python reads what is made of it, and is read once."""
    from skein.plans.catalogue import QUERIES

    for name in ("src19_posts_from_articles", "src20_posts_from_clusters"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("src02_read_rss", "src03_read_atom"):
        found = QUERIES[name](spark, sf)
        assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert found._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1


def test_moments_are_told_in_the_session_s_time(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            feed = spark.createDataFrame([(RSS, "u"), ("none", "u"), (None, None)], "body string, url string").select(D.parsed("body", "url").alias("f"))
            told = [r[0] for r in feed.selectExpr("cast(f.items[0].published_at as string)").collect()]
            assert told == ["2026-08-03 10:00:00", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_nodes_know_what_is_in_them():
    root = P.tree("<div><p>a<b>b</b><br>c</p><ul><li>1<li>2</ul></div><i>d</i>")
    div, p = root.find("div")[0], root.find("p")[0]
    assert [n.tag for n in root.walk()] == ["", "div", "p", "b", "br", "ul", "li", "li", "i"]
    assert [n.tag for n in div.walk()] == ["div", "p", "b", "br", "ul", "li", "li"] and [n.tag for n in p.walk()] == ["p", "b", "br"]
    assert div.has(p) and not p.has(div) and not div.has(root.find("i")[0])
