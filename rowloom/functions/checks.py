"""Checks that no built-in expression can make, as pandas UDFs in Arrow batches: equal formulas, clean code, METEOR."""

from __future__ import annotations

import ast
import re
import textwrap

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Words of numbers.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
GROUPS = ["", "thousand", "million", "billion", "trillion", "quadrillion"]


def boxed_answer(text: str | None) -> str | None:
    r"""Content of the last \boxed{…} with balanced braces, else what follows the last "answer is"; null if neither."""
    if text is None:
        return None
    at = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
    if at >= 0:
        start = text.index("{", at) + 1
        depth = 1
        for i in range(start, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                return text[start:i].strip()
    found = re.findall(r"(?i)answer is:?\s*(.+)", text)
    return re.sub(r"[.\s$]+$", "", found[-1]).lstrip(" $") or None if found else None


def plain_formula(text: str) -> str:
    """A formula without layout: spaces, units, degree and currency signs; short fractions and roots get their braces."""
    t = re.sub(r"\\text\{[^{}]*\}|\\(?:left|right|!|,|;|:)|\\?[$%]|\^\{?\\circ\}?|\s+", "", text)
    t = t.replace("dfrac", "frac").replace("tfrac", "frac").rstrip(".")
    t = re.sub(r"\\frac(\w)(\w)", r"\\frac{\1}{\2}", t)
    t = re.sub(r"\\sqrt(\w)", r"\\sqrt{\1}", t)
    t = re.sub(r"^(-?\d+)/(\d+)$", r"\\frac{\1}{\2}", t)
    t = re.sub(r"^(?:[a-zA-Z]=)", "", t)
    return re.sub(r"^(-?)\.(\d)", r"\g<1>0.\2", t)


def formula_value(text: str) -> float | None:
    r"""Value of a plain number or simple fraction; thousands commas are allowed."""
    m = re.fullmatch(r"(-?)\\frac\{(-?\d+(?:\.\d+)?)\}\{(-?\d+(?:\.\d+)?)\}", text)
    if m:
        return None if not float(m[3]) else float(m[1] + "1") * float(m[2]) / float(m[3])
    clean = re.sub(r"(?<=\d),(?=\d{3}\b)", "", text)
    return float(clean) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", clean) else None


def equal_formula(a: str | None, b: str | None) -> bool:
    """Whether two answers are the same formula, or numbers that agree (a percentage may be written either way); nulls never are."""
    if a is None or b is None:
        return False
    x, y = plain_formula(a), plain_formula(b)
    if x == y:
        return True
    u, v = formula_value(x), formula_value(y)
    if u is not None and v is not None:
        return any(abs(u - w) <= 1e-4 * max(1.0, abs(w)) for w in (v, v * 100, v / 100))
    inner = [re.fullmatch(r"[(\[](.+,.+)[)\]]", t) for t in (x, y)]
    if all(inner):
        p, q = (m[1].split(",") for m in inner)
        return len(p) == len(q) and all(equal_formula(s, t) for s, t in zip(p, q))
    return False


def clean_code(text: str | None, entry: str | None = None) -> str | None:
    """The runnable part of a generated program: no fences, tabs as four spaces, cut behind the last line that still parses.

    What follows the definition of `entry` at the outermost level is left out. Null if nothing parses.
    """
    if text is None:
        return None
    fence = re.search(r"```[A-Za-z]*\n(.*?)(?:```|$)", text, re.S)
    lines = textwrap.dedent((fence[1] if fence else text).expandtabs(4)).splitlines()
    while lines:
        try:
            tree = ast.parse("\n".join(lines))
        except (SyntaxError, ValueError):
            lines.pop()
            continue
        keep = tree.body
        if entry and any(isinstance(n, ast.FunctionDef) and n.name == entry for n in keep):
            last = max(i for i, n in enumerate(keep) if isinstance(n, ast.FunctionDef) and n.name == entry)
            keep = [n for i, n in enumerate(keep) if i <= last and isinstance(n, (ast.FunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign))]
        return "\n".join(x for n in keep for x in lines[(n.decorator_list[0].lineno if getattr(n, "decorator_list", None) else n.lineno) - 1 : n.end_lineno]) or None
    return None


def meteor(a: str | None, b: str | None) -> float:
    """METEOR with exact and stem matches: weighted F of the matched words, less a penalty for broken order."""
    stem = lambda w: re.sub(r"(?:ing|ed|es|s|ly)$", "", w) if len(w) > 4 else w
    x, y = ((t or "").lower().split() for t in (a, b))
    used: set[int] = set()
    pairs = {}
    for same in (lambda p, q: p == q, lambda p, q: stem(p) == stem(q)):
        for i, w in enumerate(x):
            if i not in pairs:
                j = next((j for j, v in enumerate(y) if j not in used and same(w, v)), None)
                if j is not None:
                    pairs[i] = j
                    used.add(j)
    m = len(pairs)
    if not m:
        return 0.0
    order = sorted(pairs.items())
    chunks = 1 + sum(not (i2 == i1 + 1 and j2 == j1 + 1) for (i1, j1), (i2, j2) in zip(order, order[1:]))
    p, r = m / len(x), m / len(y)
    return 10 * p * r / (r + 9 * p) * (1 - 0.5 * (chunks / m) ** 3)


def _below_thousand(n: int) -> str:
    """Words of a number under a thousand."""
    if n < 20:
        return SMALL[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{SMALL[n % 10]}" if n % 10 else "")
    return f"{SMALL[n // 100]} hundred" + (f" and {_below_thousand(n % 100)}" if n % 100 else "")


def words_of_number(text: str | None) -> str | None:
    """A whole number in words ("one hundred and five"); null for other texts and for a thousand quadrillions and more."""
    if text is None or not re.fullmatch(r"\s*[+-]?[0-9]{1,18}\s*", text):
        return None
    n = int(text)
    parts, rest, group = [], abs(n), 0
    while rest:
        rest, low = divmod(rest, 1000)
        if low:
            parts.append((_below_thousand(low) + (f" {GROUPS[group]}" if group else ""), low, group))
        group += 1
    words = [w for w, _, _ in reversed(parts)]
    # a last group under a hundred is joined by "and"
    tail = len(parts) > 1 and parts[0][2] == 0 and parts[0][1] < 100
    shown = (", ".join(words[:-1]) + f" and {words[-1]}") if tail else ", ".join(words)
    return ("minus " if n < 0 else "") + (shown or SMALL[0])


def rouge_l(a: str | None, b: str | None) -> float:
    """ROUGE-L F of two texts by their runs of letters a-z and digits, in lower case; 0 where one has none."""
    x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (a, b))
    if not x or not y:
        return 0.0
    place: dict[str, int] = {}
    for i, w in enumerate(x):
        place[w] = place.get(w, 0) | 1 << i
    full = row = (1 << len(x)) - 1
    for w in y:
        hit = row & place.get(w, 0)
        row = (row + hit | row - hit) & full
    n = len(x) - row.bit_count()
    return 2 * n / (len(x) + len(y))


@F.pandas_udf(T.StringType())
def number_words(text: pd.Series) -> pd.Series:
    return text.map(words_of_number, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def rouge_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def boxed_answers(text: pd.Series) -> pd.Series:
    return text.map(boxed_answer, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def equal_formulas(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([equal_formula(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def clean_programs(text: pd.Series) -> pd.Series:
    return text.map(clean_code, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def meteor_scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([meteor(x, y) for x, y in zip(a, b)], dtype="float64")
