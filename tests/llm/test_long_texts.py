"""Long values cost no more than in proportion, and give what the plain way gives."""

import random
import re
import time

from tarnwork.llm.langid import visible_text
from tarnwork.llm.media import automaton, sniff

HIDDEN = re.compile(rb"<(script|style|nav|noscript|template)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)


def test_visible_text_is_that_of_the_pattern():
    rng = random.Random(2)
    parts = [b"<script>", b"<SCRIPT x>", b"</script >", b"<!--", b"-->", b"<!-->", b"<nav ", b"</nav>", b"<navy>", b"a", b" b<", b">", b"</Style\n>", b"<style>", b"c "]
    for _ in range(3000):
        raw = b"".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert visible_text(raw) == re.sub(rb"<[^>]*>", b" ", HIDDEN.sub(b" ", raw)), raw


def test_open_pages_and_beginnings_of_media_are_linear():
    find = automaton()
    start = time.monotonic()
    for piece in (b"<!-- ", b"<a ", b"<script>", b"<nav x"):
        visible_text(piece * (4_000_000 // len(piece)))
    gif = b"GIF89a!" + b"\x05\x00\x00" + b"!\xf9\x04abcd"
    for piece in (gif, b"PK\x03\x04 and some more text ", b"PK\x03\x04PK\x05\x06" + bytes(18), b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda"):
        sniff(find, piece * (4_000_000 // len(piece)))
    assert time.monotonic() - start < 60
