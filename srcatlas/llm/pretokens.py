"""Splitting texts into pre-tokens as the byte-level vocabularies expect."""

from __future__ import annotations

import public_tokenizers
import regex

# The characters with Unicode's White_Space property. The pattern's ``\s`` is spelled out,
# because the expression libraries disagree about the control characters U+001C to U+001F.
WHITE_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Splitter:
    """Finds the matches of a split pattern.

    With the public pattern a blank before a character that is no white space always opens a match, so that
    a text can be cut there first and each part be looked up as a whole.
    """

    def __init__(self, pattern: str):
        spelled = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]")
        self.find = regex.compile(spelled.replace(r"\s", f"[{WHITE_SPACE}]")).findall
        self._cuts = pattern == public_tokenizers.PATTERN
        self._uneven = regex.compile(rf"\x20(?:[{WHITE_SPACE}]|\Z)").search

    def words(self, text: str) -> tuple[str, list[str]]:
        """The part before the first blank, and the parts that follow one each.

        A text where white space follows a blank stays whole.
        """
        if not self._cuts or self._uneven(text):
            return text, []
        first, *others = text.split(" ")
        return first, others
