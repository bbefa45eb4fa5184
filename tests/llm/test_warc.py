import hashlib

from timelens.llm.warc import derive

SCHEMA = "page_id long, url string, html string, content string, record_id int"
HTML = ('<!DOCTYPE html><html lang="en"><head><title> A &amp; B </title><style>p{}</style><script>var t="</p>";</script></head><body>'
        '<!-- <p>no --><p>One<br>two &lt;three&gt;</p><a href="/x">link</a> <a class="c" href="/y">y</a></body></html>')


def test_records_are_linked(ready_spark):
    got = derive(ready_spark.createDataFrame([(1, "http://a.b/c", HTML, "x", 1)], SCHEMA)).collect()
    by = {r.record_type: r for r in got}
    text = by["conversion"]
    assert text.content == "A & B\nOne\ntwo <three>\nlink y"
    assert text.block_digest == "sha256:" + hashlib.sha256(text.content.encode()).hexdigest()
    assert text.content_length == len(text.content.encode())
    assert text.refers_to == by["metadata"].refers_to and text.record_id != by["metadata"].record_id
    assert text.source_payload_digest == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    lines = text.warc_header.split("\r\n")
    assert lines[0] == "WARC/1.1" and f"WARC-Refers-To: {text.refers_to}" in lines and "WARC-Target-URI: http://a.b/c" in lines
    assert by["metadata"].content == ("title: A &amp; B\r\nlanguage: en\r\noutlinks: 2\r\nsource-http-header-lines: 2\r\noutlink: /x\r\noutlink: /y\r\n")


def test_given_columns_are_preserved(ready_spark):
    """Own ids, dates, headers and digests of a response stay; where they are null they are made."""
    schema = "page_id long, url string, html string, rid string, day string, head string, digest string, text string, date int"
    rows = [(1, "u", "<p>a", "<urn:x:1>", "2024-05-01T00:00:00Z", "HTTP/1.1 404 Not Found\r\nA: b\r\nC: d", "sha1:ABC", "t", 1), (1, "u", "<p>a", None, None, None, None, "t", 1),
            (1, "u", "<p>b", None, None, None, None, "t", 1)]
    got = derive(ready_spark.createDataFrame(rows, schema), record_id_col="rid", date_col="day", headers_col="head", digest_col="digest").collect()
    own = [r for r in got if r.refers_to == "<urn:x:1>"]
    assert len(own) == 2
    for r in own:
        lines = r.warc_header.split("\r\n")
        assert "WARC-Refers-To-Date: 2024-05-01T00:00:00Z" in lines and "WARC-Source-Payload-Digest: sha1:ABC" in lines and r.source_header == rows[0][5]
    assert "source-http-header-lines: 3" in [r.content for r in own if r.record_type == "metadata"][0]
    # Two captures of one page and url are two responses.
    assert len({r.refers_to for r in got}) == 3 and len({r.record_id for r in got}) == 6


def test_links_and_references(ready_spark):
    html = ("<a href='/s'>1</a><a id=x\nHREF = /n>2</a><a\thref=\"/d?a='b'\">3</a><area href=/no><abbr href=/no>x</abbr>"
            "&#65;&#x42;&#x1F600; &#0; &#xD800; &#9999999; &amp;#65; &#38;lt; &#38;amp; &amp;amp; &lt;b&gt; &#39;q&apos;")
    got = {r.record_type: r.content for r in derive(ready_spark.createDataFrame([(1, "u", html, "", 0)], SCHEMA)).collect()}
    assert [x[9:] for x in got["metadata"].split("\r\n") if x.startswith("outlink: ")] == ["/s", "/n", "/d?a='b'"]
    assert got["conversion"] == "123xAB\U0001f600 &#0; &#xD800; &#9999999; &#65; &lt; &amp; &amp; <b> 'q'"


def test_sql_of_edges(ready_spark):
    """The SQL gives the same rows for quotings, references and nested hidden elements."""
    import duckdb
    import pandas as pd

    from timelens.llm.warc import SQL
    rows = [(1, "u", "<a href='/s'>1</a><a id=x\nHREF = /n>2</a>&#65;&#x42;&#x1F600; &#0; &#xD800; &amp;#65; &#38;lt; &#38;amp; &#39;"), (2, None, None),
            (3, "v", "<!-- <script> --> a <script> x <!-- y </script> b --> c <STYLE>p</STYLE > <p>d</p>\n \n e <br/>f&nbsp;&amp;amp; g  "), (4, "w", " \n <p> \n </p>")]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    want = duckdb.connect().register("pages", pages).sql(SQL).df()
    got = derive(ready_spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    order = ["page_id", "record_type"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want[got.columns].sort_values(order, ignore_index=True), check_dtype=False)


def test_edges(ready_spark):
    rows = [(1, None, None, "", 0), (None, "u", "", "", 0), (2, "u", "plain", "", 0), (2, "u", "plain", "", 0), (3, "v", "<!-- open <script> x", "", 0), (4, "w", "<p>" * 5000, "", 0)]
    got = derive(ready_spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 12
    none = [r for r in got if r.page_id == 1]
    assert all("WARC-Target-URI" not in r.warc_header and r.target_uri is None for r in none)
    assert {r.content for r in none if r.record_type == "conversion"} == {""}
    twice = [r for r in got if r.page_id == 2]
    assert len({r.record_id for r in twice}) == 2 and len(twice) == 4
    assert [r.content for r in got if r.page_id == 4 and r.record_type == "conversion"] == [""]


def test_empty(ready_spark):
    assert derive(ready_spark.createDataFrame([], SCHEMA)).count() == 0
