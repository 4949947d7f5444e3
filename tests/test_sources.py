import os

from pyspark.sql import functions as F

from presswork.sources import rss, synthetic
from tests.test_tables import T0

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<rss xmlns:content="http://purl.org/rss/1.0/modules/content/" version="2.0"><channel>
<title>Feed title</title>
<item><title><![CDATA[<b>First</b> & more]]></title><link>http://x/1</link>
<description>&lt;p&gt;Summary one&lt;/p&gt;</description>
<pubDate>Mon, 01 Jan 2024 10:00:00 +0900</pubDate>
<content:encoded><![CDATA[<p>Content one</p>]]></content:encoded></item>
<item><title>Second</title><link>http://x/2</link><description>Summary two</description>
<pubDate>soon</pubDate></item>
<item><title>Third</title><link>http://x/3</link><description>Summary three</description>
<pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><content:encoded></content:encoded></item>
<item><link>http://x/4</link></item>
</channel></rss>
"""


def land(folder, source_id, text, name="feed.xml"):
    target = folder / f"source_id={source_id}"
    os.makedirs(target, exist_ok=True)
    (target / name).write_text(text, encoding="utf-8")


def test_feed_files(spark, tmp_path):
    land(tmp_path, 1, FEED)
    land(tmp_path, 2, FEED)
    items = rss.read_feed_files(spark, str(tmp_path))
    parsed = rss.parse_items(items, F.col("source_id") == 2)
    got = {(r.source_id, r.url): r for r in parsed.collect()}
    assert len(got) == 8
    assert got[1, "http://x/1"].title == "First & more"
    assert got[1, "http://x/1"].description == "Summary one"
    assert got[1, "http://x/1"].published_at.isoformat() == "2024-01-01T10:00:00"
    assert got[2, "http://x/1"].description == "Content one"
    assert got[1, "http://x/2"].published_at is None
    assert got[2, "http://x/2"].description == "Summary two"
    # A content element that is present but empty still wins where content comes first.
    assert got[1, "http://x/3"].description == "Summary three"
    assert got[2, "http://x/3"].description == ""
    assert (got[1, "http://x/4"].title, got[1, "http://x/4"].description) == ("", "")


def test_written_files_read_back(spark, tmp_path):
    rows = [(1, "a & <b>", "x\n y", None, "u1", "d"), (2, "", "&amp;", "", "u2", "yesterday")]
    items = spark.createDataFrame(
        rows, "source_id int, title string, summary string, content string, link string, published string"
    )
    path = str(tmp_path / "out")
    rss.write_feed_files(items, path)
    back = {r.source_id: r for r in rss.read_feed_files(spark, path).collect()}
    assert (back[1].title, back[1].summary, back[1].content) == ("a & <b>", "x\n y", None)
    assert (back[2].title or "", back[2].summary, back[2].link) == ("", "&amp;", "u2")


def test_top_up(spark):
    have = spark.createDataFrame([(1, synthetic.URL_PREFIX + "3")], "article_id long, url string")
    sources = spark.createDataFrame([(4, 1), (9, 2)], "source_id int, category_id int")
    rows = synthetic.top_up(have, sources, T0, target=50).collect()
    assert len(rows) == 48  # running numbers 2 to 50, of which 3 is stored
    assert {r.source_id for r in rows} == {4, 9}
    assert synthetic.top_up(have, sources, T0, target=1).count() == 0
