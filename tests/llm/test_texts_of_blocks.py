"""Short ways of the derivative builder: the same texts, addresses and digests as the long ones."""

import base64
import hashlib
import io
import random
from urllib.parse import urljoin

from cohortry.llm import html, warc

PIECES = ["<p>", "</p>", "<P class='nav'>", "<br>", "<BR/>", "<a href='/x'>", "</a>", "<b>", "</b>", "<script>a<b</script>", "<!-- c -->", "<svg/>", "<li>", "</ul>", "&amp;", "&#65;",
          "&lt;p&gt;", " one ", "two\n", " ", " ", "<", "a < b", "<!doctype html>", "<title>T</title>", "<td hidden>", "</main>", "<main>", "<x-y>", "&nosuch;", "<p unfinished='"]


def test_texts_equal_those_of_blocks():
    rng = random.Random(3)
    pages = ["", "plain", "<", "<p", "a<p", "&amp"] + ["".join(rng.choices(PIECES, k=rng.randint(1, 25))) for _ in range(3_000)]
    for page in pages:
        assert html.texts(page) == [b.text for b in html.blocks(page)], page


def test_a_conversion_does_not_weigh_blocks(monkeypatch):
    def place(*_):
        raise AssertionError("places of blocks are not asked for")

    monkeypatch.setattr(html, "_place", place)
    payload = b"<div class='nav'><a href='/a?x=1&amp;y=2'>A</a></div><p>B &amp; C</p>"
    fields = {"WARC-Record-ID": "<urn:uuid:0>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": "http://h/"}
    metadata, conversion, _ = warc.derivatives(fields, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + payload)
    (_, about), (_, text) = warc.read_records(io.BytesIO(metadata + conversion))
    assert text == b"A\nB & C" and b'"http://h/a?x=1&y=2"' in about


def test_digests_and_joined_addresses_equal_the_library_s():
    rng = random.Random(5)
    for n in range(300):
        data = rng.randbytes(n)
        assert warc.digest(data) == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    parts = ["/", "//", ".", "..", "a", "B-c", "x.html", "?", "q=1&r", "#", "f", ";p", ":", "http://h", "https://H.com", "HTTP://u", " ", "%20", "\n"]
    tails = ["", "http://h", "https://h/", "http://h.org/a/b.html?c#d", "HTTP://H/x", "http://u@h:8/a", "urn:x-none:", "http://h?x", "ftp://h/a", "https://h//a/../b"]
    for _ in range(20_000):
        target, href = rng.choice(tails), "".join(rng.choices(parts, k=rng.randint(0, 6)))
        host = warc.PLAIN_HOST.match(target)
        assert warc.joined(target, host and host[0], href) == urljoin(target, href), (target, href)
