import base64
import hashlib
import html
import re

from semblance.llm.warc_derivatives import derivatives, responses_of, warc_bytes

PAGE = '<html><head><title>A &amp;\n B &#233;</title><style>p{x}</style><script>var a="<p>no</p>";</script></head><body><!-- gone <b> --><p>One&nbsp;two<br>three <a href="/x?y=1">link</a></p><a href=\'z\'>z</a><div>&#x41;&#XE9; &#x; &#xD800; &lt;tag&gt; &copy; &#128512;</div></body></html>'


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def rows_of(spark, rows):
    pages = spark.createDataFrame([(a, b, c, "w", 1) for a, b, c in rows], "page_id long, url string, html string, block string, _text int")
    return warc_bytes(derivatives(responses_of(pages))).collect()


def test_linked_records(spark):
    got = rows_of(spark, [(1, "http://a.b/c", PAGE), (1, "http://a.b/c", PAGE), (2, None, None), (None, "u", ""), (3, "http://l.l/", "<p>" + "long text " * 50_000)])
    assert len(got) == 10
    for r in got:
        block = r.block.encode()
        assert r.content_length == len(block) and r.block_digest == digest(block)
        head, _, rest = bytes(r.warc).partition(b"\r\n\r\n")
        assert rest == block + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: " + r.warc_type.encode())
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to and fields["Content-Length"] == str(len(block)) and fields.get("WARC-Target-URI") == r.target_uri
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id) and r.record_id != r.refers_to
    one = {r.warc_type: r for r in got if r.source_id == 1}
    assert one["conversion"].refers_to == one["metadata"].refers_to and one["metadata"].source_digest == digest(PAGE.encode())
    assert one["conversion"].block == "A &\nB é\nOne two\nthree link\nz\nAé &#x; &#xD800; <tag> © 😀"
    assert one["metadata"].block.split("\r\n") == [
        "title: A & B é", "outlink: /x?y=1", "outlink: z", "source-header: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8",
        f"source-header: Content-Length: {len(PAGE.encode())}", f"source-payload-digest: {digest(PAGE.encode())}", "",
    ]
    blank = [r for r in got if r.source_id == 2]
    assert {r.warc_type: r.block for r in blank}["conversion"] == "" and all(r.target_uri is None for r in blank)
    assert len({r.record_id for r in got}) == 8
    assert html.unescape("&copy;") == "©"


def test_headers_come_from_the_callers_column(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "HTTP/1.1 404 Not Found\r\nServer: s\r\n\r\n"), (2, "http://b/", None, None)], "page_id long, url string, html string, http string")
    got = {r.source_id: r.block for r in derivatives(responses_of(pages, headers_col="http")).where("warc_type = 'metadata'").collect()}
    assert got[1].startswith("source-header: HTTP/1.1 404 Not Found\r\nsource-header: Server: s\r\nsource-payload") and "Content-Length: 0" in got[2]


def test_empty_table(spark):
    assert rows_of(spark, []) == []
