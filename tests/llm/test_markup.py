"""Pages and archives whose markup would make a walk back over all that is open, or a join of all that was read, quadratic."""

import time

from corpusloom.llm import main_text, warc


def test_pages_of_odd_markup_take_linear_time():
    n, began = 40_000, time.time()
    for page in ("<div>" * n + "</b>" * n, "<b>" * n + "<li>x" * n, "<b>" * n + "<div></div>" * n, "<div><i>" * n + "</p>" * n, "</div>" * n):
        main_text.parse(page)
    assert time.time() - began < 20


def test_what_ends_an_element():
    parse = lambda source: [(main_text.parse(source).tags[e], text) for e, text, _ in main_text.parse(source).texts]
    assert parse("<p>a<p>b</p>c") == [("p", "a"), ("p", "b"), ("#page", "c")]
    assert parse("<p>a<b>b<div>c</div>d") == [("p", "a"), ("b", "b"), ("div", "c"), ("#page", "d")]
    assert parse("<ul><li>a<ul><li>b</ul>c<li>d</ul>e") == [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("#page", "e")]
    assert parse("<table><tr><td>a<td>b<tr><th>c</table></b></td>d") == [("td", "a"), ("td", "b"), ("th", "c"), ("#page", "d")]
    assert parse("<div><i>a</div>b</i>c") == [("i", "a"), ("#page", "b"), ("#page", "c")]


def _record(i, body):
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (i, warc.base32_sha1(body).encode(), len(http)) + http + b"\r\n\r\n"


def test_a_payload_of_many_heads():
    """Payloads that hold whole archives are read as they are, each joined once."""
    inner = b"".join(_record(i, b"x" * i) for i in range(3))
    bodies = [b"", inner, b"\r\n\r\nWARC/1.1\r\n", b"\r\n\r\n", b"WARC/1.1\r\n" * 3, inner + b"\r\n\r\n", b"\r\n\r\nWARC/1.1\r\n" * 80_000]
    began, stream, found = time.time(), warc.RecordStream(True), []
    for name, some in (("a", bodies), ("b", bodies[::-1])):
        for piece in b"".join(_record(i, x) for i, x in enumerate(some)).split(warc._NEXT.encode()):
            found += stream.add(name, piece)
    found += stream.end()
    assert [r[-1] for r in found] == bodies + bodies[::-1]
    assert time.time() - began < 10
