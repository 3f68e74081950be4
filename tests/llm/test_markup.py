"""The language operator's markup scan: as plain patterns say, and in linear time."""

import random
import re
import time

import pytest

from meridia.llm import language

DROP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
PIECES = ["<", ">", "<script", "</script>", "<STYLE a>", "</style >", "<!--", "-->", "<html ", "lang=", "'en'", "fr", " ", "text", "&amp;", "<b>", "--", "!", "</script", "xlang=\"de\"", "\n"]


def test_markup_as_by_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        page = "".join(r.choice(PIECES) for _ in range(r.randint(0, 14)))
        assert language.visible_text(page) == language._ENTITY.sub(" ", DROP.sub(" ", page)), page
        told = DECLARED.search(page)
        assert language.declared_language(page) == (told[1].lower() if told else ""), page


@pytest.mark.parametrize("piece", ["<", "<script ", "<style>", "<!-- ", "<html ", "<html lang ", "<b ", "</script ", "<script></style>"])
def test_five_megabytes_that_never_close(piece):
    page = piece * (5_000_000 // len(piece))
    began = time.time()
    language.visible_text(page)
    language.declared_language(page)
    assert time.time() - began < 5
