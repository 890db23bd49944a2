"""Words of a text as bytes: what ranked search and the divergence audit count.

A word is a maximal run of the given bytes; bytes from 0x80 on (all that UTF-8 uses beyond ASCII) are in both
alphabets, so a run of bytes is a run of code points. Only A-Z are lower-cased. Texts are read in windows of
WINDOW bytes that end between words, so the list of a very long text's words is never whole in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

WINDOW = 1 << 20
LETTERS_DIGITS = rb"0-9A-Za-z\x80-\xff"
LETTERS = rb"A-Za-z\x80-\xff"


class Words:
    def __init__(self, alphabet: bytes, window: int = WINDOW):
        self.inside, self.outside, self.window = re.compile(b"[" + alphabet + b"]+"), re.compile(b"[^" + alphabet + b"]"), window

    def lists(self, text: bytes | None) -> Iterator[list[bytes]]:
        """The words in order, a list a window; nothing for null."""
        low, at = (text or b"").lower(), 0  # of bytes, so A-Z only
        while at < len(low):
            end = at + self.window
            gap = self.outside.search(low, end)
            end = gap.start() if gap else len(low)
            yield self.inside.findall(low, at, end)
            at = end
