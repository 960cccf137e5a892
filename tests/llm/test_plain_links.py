from __future__ import annotations

import itertools
from urllib.parse import urljoin

import pytest

from cohortry.llm import warc
from cohortry.llm.html import texts


def test_words_as_paths_are_joined_without_parsing(monkeypatch):
    base = "http://h.example.net/en/7?u=f"
    names = ["the,", "für", "x.", ".y", "..", ".", "a..b", ",", "é.", "a.b,c", ""]
    wanted = {h: urljoin(base, h) for h in ("/" + "/".join(p) + t for p in itertools.product(names, repeat=2) for t in ("", "/", "?a=b#f"))}
    assert {h: warc.joined(base, "http://h.example.net", h) for h in wanted} == wanted
    monkeypatch.setattr(warc, "urljoin", lambda *a: pytest.fail("parsed"))
    assert warc.joined(base, "http://h.example.net", "/für/the,/x.") == "http://h.example.net/für/the,/x."


def test_blank_pieces_between_blocks_are_no_text():
    assert texts("<DIV>\n<p> a <BR>b</P>\n \n<p>&nbsp;</p>\n<p>c</p></DIV>") == ["a b", "c"]
