"""Words of a text for comparison: without case, marks, spacing and Unicode form."""

from __future__ import annotations

import html
import re
import unicodedata
import zlib

#: Fixed value: scripts compared by character.
_CJK = "々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿︎️]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->", re.S)
_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(f"[{_CJK}]|(?:(?![{_CJK}])[^\\W_])+")
_ANY_CJK = re.compile(f"[{_CJK}]")


def fold(text: str) -> str:
    """The text in one Unicode form and case, without invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).casefold())


def strip_markup(text: str) -> str:
    """The text without tags and character references."""
    if "&" in text:
        text = html.unescape(text)
    return _TAG.sub(" ", text) if "<" in text else text


def words(text: str) -> list[str]:
    """Runs of letters and digits."""
    return _WORD.findall(fold(text))


def units(text: str) -> list[str]:
    """Words, and single characters in Chinese and Japanese."""
    folded = fold(text)
    return _WORD.findall(folded) if folded.isascii() else _UNIT.findall(folded)


def cjk_share(text: str) -> float:
    """Share of Chinese and Japanese characters among letters and digits."""
    letters = sum(len(w) for w in _WORD.findall(text))
    return len(_ANY_CJK.findall(text)) / letters if letters else 0.0


def has_cjk(text: str) -> bool:
    return not text.isascii() and _ANY_CJK.search(text) is not None


def word_code(word: str) -> int:
    """A number for a word that is the same in every process (58 bits)."""
    raw = word.encode("utf-8", "replace")
    return zlib.crc32(raw) << 26 | zlib.adler32(raw) & 0x3FFFFFF


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by one big integer per row."""
    if not a or not b:
        return 0
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        match = place.get(y)
        if match is not None:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Words of an answer that says nothing, after folding, joined by one space.
NOTHING = {
    "", "n a", "na", "nan", "nil", "none", "null", "no answer", "no response", "no output", "no data", "no comment", "not available", "not applicable",
    "empty", "blank", "tbd", "todo", "missing", "unknown", "undefined", "placeholder", "answer", "your answer here", "insert answer here", "see above",
    "keine antwort", "sans réponse", "sin respuesta", "无", "無", "なし", "空", "没有", "無し",
}


def says_nothing(text: str | None) -> bool:
    """Whether an answer is null, blank, only marks or markup, or a placeholder."""
    if text is None:
        return True
    if len(text) > 60:
        return not words(strip_markup(text)) and not any(unicodedata.category(c) == "So" for c in text)
    found = " ".join(words(strip_markup(text)))
    if found:
        return found in NOTHING
    # a lone symbol such as an emoji can be an answer; marks and blanks can't
    return not any(unicodedata.category(c) == "So" for c in text)
