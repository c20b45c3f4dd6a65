"""Sentence units across languages and scripts: a hidden-event model over the marks of a text."""

from __future__ import annotations

import marshal
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import durable, spread

#: End marks, and the marks that open and close quotations and brackets.
END_MARKS = ".!?…。！？｡．।॥؟۔‼⁇⁈⁉"
OPENERS = "([{（［｛「『《〈【〔〖“„‟‘‚«‹»›\"¿¡—–-*_•·‣"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "｛": "｝", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "〖": "〗", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹"}
CLOSERS = set(")]}）］｝」』》〉】〕〗”“’»«›‹\"'")
#: Weight of a shape's share of words in the share of one of its words.
BACKOFF = 0.01
#: Log odds of a boundary by what parts the mark from what follows: nothing, blanks, a line break; in scripts without
#: spaces, nothing behind a closing mark, where the sentence mostly goes on.
#: A Thai space that touches no digit, Latin letter or repetition mark mostly ends a sentence, another one hardly ever.
GAP_ODDS = {"-": -2.5, "s": 0.3, "n": 0.8, "q": -2.0, "t": 6.0, "T": -6.0}
#: Log odds of two boundaries with at most one word between them.
SHORT_ODDS = -1.5

#: Left type of a Thai space, where a boundary can stand without a mark.
THAI = "<thai>\t\t"
#: Share of boundaries below which what follows a left type counts as standing inside sentences.
SELDOM = 0.05
#: Weight of the words behind all words against those behind one left type.
PAIR_WEIGHT = 50.0
#: Tables of counts, each of fixed size whatever the vocabulary (2**bits places by hash): left types and their classes and marks,
#: words at paragraph starts and behind words with their shapes, and pairs of left type and word behind it.
TABLES = {"left": 18, "class": 12, "marks": 12, "after": 18, "inside": 18, "after_shape": 8, "inside_shape": 8, "pairs": 20}

_MARKS = re.escape(END_MARKS)
_DOTTED = r"(?<![^\W\d_])(?:[^\W\d_]\.)+[^\W\d_](?![^\W_])|(?<![^\W\d_])Ph\.D(?![^\W_])"
_SITE = re.compile(f"[{_MARKS}]+")
_PARAGRAPH = re.compile(r"(?:[^\S\n]*(?:\r?\n| |\x85)){2,}| ")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")
_WORD = re.compile(r"[^\W_][\w'’ऀ-෿฀-໿̀-ͯ]*")
_THAI = re.compile(r"[ก-๛]")
_THAI_GAP = re.compile(r"(?<=\S)\s+(?=\S)")
_TOUCH = re.compile(r"[0-9๐-๙A-Za-zÀ-ɏๆ]")
_PAIRED = re.compile("[" + re.escape('"' + "".join(PAIRS) + "".join(PAIRS.values())) + "]")
_DOTTED_END = re.compile(f"(?:{_DOTTED})$")
_BLANKS = re.compile(r"\s*")
_LEAD = re.compile("[" + re.escape(OPENERS) + "   ]*")
_NUMBERED = re.compile(r"[0-9]{1,3}[.)]\s")
_MID = re.compile("(?:(?<=[^\\W\\d_])[ \u00a0]|[\uff0c\u3001,][ ]?)([^\\W_][\\w'\u2019]*\\.?)")
_LIST = re.compile(r"[^\S\n]*(?:\(?[0-9]{1,3}|[A-Za-z]|[ivxIVX]{1,4})$")


def shape(word: str) -> str:
    """Class of a word: its script, and how it is capitalised."""
    if not word:
        return "<none>"
    if word[0] == "<" and word[-1] == ">" and len(word) > 2:
        return word
    c = word[0]
    if c.isdigit():
        return "<9>"
    if _CJK.match(c):
        return "<cjk>"
    if c.isupper():
        return "<A>" if len(word) == 1 else ("<AA>" if word.isupper() else "<Aa>")
    if c.islower():
        return "<aA>" if any(x.isupper() for x in word[1:]) else "<a>"
    if c.isalpha():
        return "<x>"
    return "<mark>"


def _matched(text: str) -> np.ndarray | None:
    """Depth of quotations and brackets at each character; only pairs closed within the paragraph count. None: no pair."""
    depth = None
    stack: list[tuple[str, int]] = []
    for m in _PAIRED.finditer(text):
        i, c = m.start(), m.group()
        if c == '"':
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            # a straight quote closes one that is open unless it stands before a word and after a blank
            opens = (i == 0 or text[i - 1].isspace() or text[i - 1] in "(（") and i + 1 < len(text) and not text[i + 1].isspace()
            if at is None:
                stack.append((c, i))
            if at is None or opens:
                continue
        else:
            at = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS.get(stack[k][0], "")), None)
            if at is None:
                if c in PAIRS:
                    stack.append((c, i))
                continue
        if depth is None:
            depth = np.zeros(len(text) + 1, dtype=np.int32)
        depth[stack[at][1]] += 1
        depth[i] -= 1
        del stack[at:]
    return None if depth is None else np.cumsum(depth)[:-1]


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    if text.count("\n") < 2 and "\u2029" not in text and "\x85" not in text:
        yield at, len(text)
        return
    for m in _PARAGRAPH.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _right_type(text: str, m: re.Match) -> str:
    """Type of the word behind a site: the word, or a class for list numbers, numbers and initials."""
    w = m.group()
    if w[0].isdigit():
        return "<item>" if _NUMBERED.match(text, m.start()) else "<9>"
    if _CJK.match(w):
        return w[0]
    if len(w) == 1 and w.isupper() and text[m.end() : m.end() + 1] == ".":
        return "<initial>"
    return w[:24]


def _word_before(text: str) -> str:
    """The word that a text ends with, vowel signs and combining marks of any script with it."""
    k = len(text)
    while k and (text[k - 1].isalnum() or "\u0900" <= text[k - 1] <= "\u0dff" or "\u0300" <= text[k - 1] <= "\u036f"):
        k -= 1
    return text[k:]


def _inside_dotted(text: str, s: int) -> bool:
    """Whether the point at `s`, which a letter follows, stands between the letters of an abbreviation such as U.K or Ph.D."""
    if s < 1 or not text[s - 1].isalpha() or text[s + 2 : s + 3].isalnum():
        return False
    if s < 2 or not text[s - 2].isalpha():
        return True
    return text[s - 2 : s] == "Ph" and not text[max(0, s - 3) : s - 2].isalpha()


def find_sites(text: str) -> tuple[list[tuple[int, int, str, str, str, int]], list[int], list[str]]:
    """Places where a sentence may end, places where it surely does, and the words that paragraphs begin with.

    A site is (paragraph, position after the mark and its closing marks, left type with the marks, gap, right word, words
    since the site before). The right word is `<end>` at the end of a paragraph.
    """
    sites, sure, starts = [], [], []
    for p, (lo, hi) in enumerate(_paragraphs(text)):
        part = text[lo:hi]
        if not part.strip():
            continue
        sure.append(lo)
        first = _WORD.search(part)
        if first:
            starts.append(_right_type(part, first))
        gaps = []
        if _THAI.search(part):
            for m in _THAI_GAP.finditer(part):
                a, b = part[m.start() - 1], part[m.end()]
                if _THAI.match(a) or _THAI.match(b):
                    r = _WORD.match(part, m.end())
                    free = not _TOUCH.match(a) and not _TOUCH.match(b)
                    gaps.append((p, lo + m.end(), THAI, "t" if free else "T", _right_type(part, r)[:6] if r else "<mark>", 9))
        depth, known = None, False
        before = 0
        for m in _SITE.finditer(part):
            marks = m.group()
            s, e = m.span()
            after = part[e] if e < len(part) else ""
            if marks == "." and after.isalpha() and _inside_dotted(part, s):
                continue  # a dotted abbreviation counts as the left word of the mark behind it
            if marks == "." and after.isdigit() and (s == 0 or part[s - 1].isdigit() or not part[s - 1].isalnum()):
                continue  # a decimal point
            if not known:
                depth, known = _matched(part), True
            end = e
            while end < len(part):
                c = part[end]
                if c in CLOSERS and depth is not None and depth[end] < depth[end - 1]:
                    end += 1
                elif c in "'’" and end + 1 < len(part) and not part[end + 1].isalnum():
                    end += 1
                elif c in "   " and end + 1 < len(part) and part[end + 1] in "»«›‹" and depth[end + 1] < depth[end]:
                    end += 2
                else:
                    break
            if depth is not None and depth[end - 1] > 0:
                continue  # inside a quotation or bracket that goes on
            ahead = _BLANKS.match(part, end).end()
            nxt = part[ahead : ahead + 1]
            if nxt and nxt in ",;:，、；：)）]％%/":
                continue
            back = part[max(0, s - 40) : s]
            word = _word_before(back)
            kind = "*"
            if marks == "." or marks == "．":
                long = _DOTTED_END.search(back[-12:]) if "." in back[-3:] else None
                w = long.group() if long else word
                if w.isdigit():
                    line = part.rfind("\n", 0, s) + 1
                    if s - line <= 12 and _LIST.fullmatch(part, line, s) and part[end : end + 1].isspace():
                        continue  # a list number
                    kind = "<9>"
                elif not w:
                    bare = back.rstrip()
                    kind = "<sp>" if back[-1:].isspace() and bare else ("<sym>" if bare else "<none>")
                else:
                    kind = w.casefold() if len(w) > 1 else w
            elif set(marks) <= {".", "…"}:
                kind = word.casefold() if word else "<sp>"
            if len(kind) > 24:
                kind = "<long>"
            closing = "".join(c for c in part[e:end] if not c.isspace())
            left = f"{kind}\t{marks[:4]}\t{closing[:3]}"
            lead = _LEAD.match(part, ahead).end()
            r = _WORD.match(part, lead)
            right = _right_type(part, r) if r else ("<end>" if lead >= len(part) else "<mark>")
            if len(right) > 1 and right.isupper() and len(word) > 1 and word.isupper():
                right = right.capitalize()  # a passage in capitals
            if ahead == end and marks == "." and shape(right) == "<a>":
                continue  # an address or file name
            g = "n" if "\n" in part[end:ahead] else ("s" if ahead > end else "-")
            if _CJK.match(back[-1:]) or _CJK.match(right) or "।" in marks:
                g = ("q" if closing else "c") if g == "-" else g
            between = part[before:s]
            sites.append((p, lo + ahead, left, g, right, len(between.split()) if not _CJK.search(between) else 9))
            before = end
        if gaps:
            marked = {s[1] for s in sites}
            sites = sorted([*sites, *[g for g in gaps if g[1] not in marked]], key=lambda s: s[1])
    return sites, sure, starts


def mid_words(found: Counter) -> Counter:
    """Counts of words that surely begin no sentence, from what _MID finds: those behind another word with only a blank between them,
    or behind a comma."""
    merged: Counter = Counter()
    for w, n in found.items():
        if w[-1] == ".":
            w = "<initial>" if len(w) == 2 and w[0].isupper() else w[:-1]
        if w[0].isdigit():
            w = "<9>"
        merged[w[0] if _CJK.match(w) else w[:24]] += n
    return merged


def place(table: str, key: str) -> int:
    """Place of a key in a table of counts."""
    return zlib.crc32(key.encode("utf-8", "replace")) >> (32 - TABLES[table])


def left_class(key: str) -> str:
    """Class of a left type that lends statistics to rare words: its length and kind, with the marks."""
    kind, _, marks = key.partition("\t")
    if not kind[:1].isalpha():
        return key
    if "." in kind:
        return f"dotted\t{marks}"
    return f"{'letter' if len(kind) == 1 else 'short' if len(kind) <= 5 else 'long'}\t{marks}"


def count_events(sites: Counter, after: Counter, inside: Counter) -> list[tuple[str, int, int, int]]:
    """Counts of places (`table`, `place`, `n`, `e`) from those of sites (left type, right word), of words at paragraph starts and
    behind words; those of classes and shapes are added."""
    left: dict[str, list[int]] = {}
    pairs: list[tuple[str, int, int, int]] = []
    shapes: dict[str, tuple[int, int]] = {}
    for (kind, right), n in sites.items():
        c = left.get(kind)
        if c is None:
            c = left[kind] = [0, 0, place("left", kind)]
        c[0] += n
        if right == "<end>":
            c[1] += n
            continue
        if right not in shapes:
            shapes[right] = place("inside", right), place("inside_shape", shape(right))
        # pairs keep both places, and that of the right word's shape
        pairs.append(("pairs", c[2] << 32 | shapes[right][0], n, shapes[right][1]))
    found: dict[tuple[str, int], list[int]] = {}

    def add(table: str, at: int, n: int, e: int = 0) -> None:
        c = found.setdefault((table, at), [0, 0])
        c[0] += n
        c[1] += e

    for kind, (n, e, at) in left.items():
        add("left", at, n, e)
        add("class", place("class", left_class(kind)), n, e)
        add("marks", place("marks", kind.partition("\t")[2]), n, e)
    for table, words in (("after", after), ("inside", inside)):
        for w, n in words.items():
            add(table, place(table, w), n)
            add(f"{table}_shape", place(f"{table}_shape", shape(w)), n)
    return [(t, k, n, e) for (t, k), (n, e) in found.items()] + pairs


def pair_place(left: int, right: int) -> int:
    """Place of a pair in its table, from the places of its parts."""
    return (left * 0x9E3779B1 ^ right * 0x85EBCA77) % (1 << TABLES["pairs"])


class BoundaryModel:
    """Hidden-event bigram model over words and boundary tokens, joined by forward-backward.

    At each site: P(boundary | left type) P(right word | boundary) against P(no boundary | left type) P(right word | left type).
    """

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray]]):
        """Per table the counts by place, and of these the ones at paragraph ends."""
        full = {t: tables.get(t, (np.zeros(1 << bits), np.zeros(1 << bits))) for t, bits in TABLES.items()}
        self.counts = {t: n for t, (n, _) in full.items()}
        self.ends = {t: full[t][1] for t in ("left", "class", "marks")}
        n, e = self.counts["marks"], self.ends["marks"]
        # a paragraph ends at this share of true boundaries: taken from the full stops, whose left words are mostly true ends
        self.end_share = max(float(e.sum() / n.sum()) if n.sum() else 0.2, 1e-3)
        strong = np.sort((e[(n >= 50) & (e > 0)] / n[(n >= 50) & (e > 0)]))[::-1]
        if len(strong):
            self.end_share = float(np.median(strong[: max(1, len(strong) // 2)]))
        self.n_after, self.n_inside = max(1.0, float(self.counts["after"].sum())), max(1.0, float(self.counts["inside"].sum()))
        self.known: dict[tuple[str, str, str], float] = {}
        # left types that as good as never end a sentence, by place: their right words are words inside sentences
        k, e = self.counts["left"], self.ends["left"]
        weight = np.where((e == 0) & (k >= 20), 0.3, 3.0)
        share = (e + weight * 0.5 * self.end_share) / ((k + weight) * self.end_share)
        self.inner = np.where((k > 0) & (share < SELDOM), np.minimum(1.0, np.maximum(0.0, 1 - share)), 0.0).astype(np.float32)

    def _share(self, table: str, key: str) -> float:
        """Share of boundaries among the sites of a class, smoothed."""
        k, e = self.counts[table][place(table, key)], self.ends[table][place(table, key)]
        return float(min(0.97, (e + 0.5 * self.end_share) / ((k + 0.5) * self.end_share)))

    def prior(self, left: str) -> float:
        """P(boundary | left type): how often it ends a paragraph against how often it stands anywhere."""
        if left == THAI:
            return 0.5
        at, kind = place("left", left), left_class(left)
        k, e = self.counts["left"][at], self.ends["left"][at]
        if not k:
            if self.counts["class"][place("class", kind)]:
                return max(0.003, self._share("class", kind))
            marks = left.partition("\t")[2]
            return max(0.02, self._share("marks", marks)) if self.counts["marks"][place("marks", marks)] else 0.5
        # long words are seldom abbreviations; a word that is often seen and never ends a paragraph is one
        weight = 15.0 if kind.startswith("long") else (0.3 if not e and k >= 20 else 3.0)
        share = (e + weight * self._share("class", kind) * self.end_share) / ((k + weight) * self.end_share)
        return float(min(0.995, max(0.0005, share)))

    def _word_odds(self, left: str, prior: float, w: str) -> float:
        """Log of P(word | boundary) / P(word | left type, no boundary)."""
        if w == "<mark>":
            return -0.5
        s = shape(w)
        # the shape's share, smoothed so that a shape seen on neither side says nothing
        like_after = (self.counts["after_shape"][place("after_shape", s)] + 1e-4 * self.n_after) / self.n_after
        like_inside = (self.counts["inside_shape"][place("inside_shape", s)] + 1e-4 * self.n_inside) / self.n_inside
        if s in ("<cjk>", "<x>"):  # scripts without capitals: their shape says nothing
            like_after = like_inside = 0.1
        up = self.counts["after"][place("after", w)] / self.n_after + BACKOFF * like_after
        down = self.counts["inside"][place("inside", w)] / self.n_inside + BACKOFF * like_inside
        alone = math.log(up / down)
        # expectation: how many of the other pairs of this left type and word hold no boundary, by each side alone
        pairs = max(0.0, self.counts["pairs"][pair_place(place("left", left), place("inside", w))] - 1.0)
        inner = pairs * (1 - prior) ** 2 / (1 + math.exp(max(-30.0, min(30.0, alone))))
        n = self.counts["left"][place("left", left)] * (1 - prior)
        # maximisation: the bigram where it says more than the words behind all words, to which unseen pairs back off whole
        down = max(down, (inner + PAIR_WEIGHT * down) / (max(n, inner) + PAIR_WEIGHT))
        return max(-7.0, min(7.0, math.log(up / down)))

    def odds(self, left: str, gap: str, right: str) -> float:
        """Log odds of a boundary at a site by its own words and marks."""
        if right == "<end>":
            return 20.0
        p = self.prior(left)
        words = self._word_odds(left, p, right)
        if left == THAI:
            words = max(-3.0, min(3.0, words))
        return math.log(p / (1 - p)) + words + GAP_ODDS.get(gap, 0.0)

    def boundaries(self, sites: list[tuple]) -> list:
        """Places of the sites at which a sentence ends: posterior above one half, by forward-backward over a paragraph's sites."""
        out = []
        k = 0
        while k < len(sites):
            j = k
            while j < len(sites) and sites[j][0] == sites[k][0]:
                j += 1
            part = sites[k:j]
            own = []
            for s in part:
                known = self.known.get(tuple(s[2:5]))
                if known is None:
                    if len(self.known) > 200_000:
                        self.known.clear()
                    known = self.known[tuple(s[2:5])] = self.odds(s[2], s[3], s[4])
                own.append(known)
            if all(abs(x) > -2 * SHORT_ODDS for x in own):  # its neighbours can shift a site's log odds by no more
                out += [s[1] for s, x in zip(part, own) if x > 0]
                k = j
                continue
            emit = np.array([[0.0, x] for x in own])
            # forward and backward messages in log space; state 1 is a boundary
            forward = np.zeros((len(part), 2))
            backward = np.zeros((len(part), 2))
            step = [np.array([[0.0, 0.0], [0.0, SHORT_ODDS if s[5] <= 1 else 0.0]]) for s in part]
            forward[0] = emit[0] + step[0][1]  # a paragraph begins behind a boundary
            for i in range(1, len(part)):
                forward[i] = emit[i] + np.logaddexp(forward[i - 1][0] + step[i][0], forward[i - 1][1] + step[i][1])
            for i in range(len(part) - 2, -1, -1):
                ahead = backward[i + 1] + emit[i + 1]
                backward[i] = np.logaddexp(step[i + 1][:, 0] + ahead[0], step[i + 1][:, 1] + ahead[1])
            total = forward + backward
            out += [s[1] for s, (no, yes) in zip(part, total) if yes > no]
            k = j
        return out


def edge(text: str, cut: int) -> tuple[int, int]:
    """Where the text before a cut ends and where the text behind it begins, blanks left out."""
    before, behind = cut, cut
    while before and text[before - 1].isspace():
        before -= 1
    while behind < len(text) and text[behind].isspace():
        behind += 1
    return before, behind


def between(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sentences between edges, those of the text's ends included; blank stretches give none."""
    edges = sorted(set(edges))
    return [(a, b) for (_, a), (b, _) in zip(edges, edges[1:]) if a < b]


def spans(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    """Sentences between the cuts, from their first to their last non-blank character."""
    return between([edge(text, c) for c in (0, len(text), *cuts)])


def split_sentences(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every sentence of every text (`key`, `start_pos`, `end_pos`), positions in code points, the end exclusive.

    The marks of a text are sites of a hidden boundary event. The model's statistics come from the whole corpus: how often a
    word with its marks ends a paragraph against how often it stands anywhere tells abbreviations and inner quotations
    from true ends; words at paragraph starts and words behind words tell how a sentence begins. Forward-backward
    over the sites of each paragraph gives the posteriors. Thai spaces are sites like marks; whether they touch a digit, Latin
    letter or repetition mark is their strongest evidence. Blank lines always part sentences. Marks inside a closed quotation or bracket, decimal points, dotted
    abbreviations and list numbers are no sites. A paragraph without sites is one sentence. Null, empty and blank texts
    give no row; texts of any length are read whole; repeated rows give repeated sentences; an empty table gives no row.
    """
    rows = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, after, inside = Counter(), Counter(), Counter()
            packed = []
            for t in batch["text"]:
                sites, sure, starts = find_sites(t)
                after.update([w[:24] for w in starts])
                inside.update(_MID.findall(t))
                seen.update([(x[2], x[4]) for x in sites])
                packed.append(marshal.dumps(([edge(t, c) for c in (0, len(t), *sure)], [(s[0], edge(t, s[1]), *s[2:]) for s in sites])))
            counted = count_events(seen, after, mid_words(inside))
            yield pd.DataFrame(
                {
                    "what": ["text"] * len(packed) + [c[0] for c in counted], "k": [0] * len(packed) + [c[1] for c in counted],
                    "n": [0] * len(packed) + [c[2] for c in counted], "e": [0] * len(packed) + [c[3] for c in counted],
                    "key": pd.Series([*batch["key"].tolist(), *[None] * len(counted)], dtype="object"), "packed": pd.Series([*packed, *[None] * len(counted)], dtype="object"),
                }
            )

    # one pass over the texts: their sites and what they add to the statistics
    parsed = durable(rows.mapInPandas(parse, f"what string, k long, n long, e long, key {kind}, packed binary"))
    tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def gather(counts: DataFrame) -> None:
        """Add counts to the tables: at most as many rows as these have places, however large the vocabulary."""
        found = counts.groupBy("what", "k").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).toArrow().to_pandas()
        for what, rows_ in found.groupby("what"):
            n, e = tables.setdefault(what, (np.zeros(1 << TABLES[what], dtype=np.float32), np.zeros(1 << TABLES[what], dtype=np.float32)))
            n[rows_["k"].to_numpy()] += rows_["n"].to_numpy()
            e[rows_["k"].to_numpy()] += rows_["e"].to_numpy()

    gather(parsed.where("what not in ('text', 'pairs')").select("what", "k", F.col("n").cast("double").alias("n"), F.col("e").cast("double").alias("e")))
    inner = df.sparkSession.sparkContext.broadcast(BoundaryModel(tables).inner)

    def inside_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right, n = batch["k"].to_numpy() >> 32, batch["k"].to_numpy() & 0xFFFFFFFF, batch["n"].to_numpy(dtype=float)
            within = n * inner.value[left]
            kept = within > 0
            for what, k, x in (("pairs", [pair_place(int(a), int(b)) for a, b in zip(left, right)], n), ("inside", right[kept], within[kept]), ("inside_shape", batch["e"].to_numpy()[kept], within[kept])):
                yield pd.DataFrame({"what": what, "k": pd.Series(k, dtype="int64"), "n": x, "e": 0.0})

    gather(parsed.where("what = 'pairs'").select("k", "n", "e").mapInPandas(inside_words, "what string, k long, n double, e double"))
    model = df.sparkSession.sparkContext.broadcast(BoundaryModel(tables))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, a, b = [], [], []
            for k, p in zip(batch["key"], batch["packed"]):
                sure, sites = marshal.loads(p)
                for s, e in between([*map(tuple, sure), *map(tuple, model.value.boundaries(sites))]):
                    keys.append(k)
                    a.append(s)
                    b.append(e)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=batch["key"].dtype), "start_pos": pd.Series(a, dtype="int64"), "end_pos": pd.Series(b, dtype="int64")})

    return parsed.where("what = 'text'").select("key", "packed").mapInPandas(cut, f"key {kind}, start_pos long, end_pos long").withColumnRenamed("key", key)
