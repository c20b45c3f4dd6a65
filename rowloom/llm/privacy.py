"""Personal information in free text: labelers vote, expectation-maximisation weighs them, a classifier of spans decides."""

from __future__ import annotations

import marshal
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.session import durable, spread

TYPES = ("email", "phone", "id_number", "address", "name")
#: Vote patterns that the label model and the classifier are fitted on, by frequency; a pattern is a type with its votes and marks.
PATTERNS = 5_000
ROUNDS = 40

#: Gazetteers and cue words.
GIVEN_NAMES = frozenset(
    """aiko ahmed alice amara amir amelia ana andrea andrei anita anna anouk antonio arjun astrid ben bruno camille carla carlos carmen chen chidi
    chloe clara claire dario david diego dilan dmitri elena elif emma emre eric eva farah fatima felix francesca freya gabriel george giulia greta hana hans
    hassan helen henry hugo ibrahim igor ines ingrid irina isabel ivan ivo jack james jan jane jean john jonas jorge joris jose juan julia kofi kenji
    lars laura layla leila lena leo lina lisa luca lucas lucia luis maeve marek maria marta martin mateo matteo max mei mia michael miguel milo
    mohammed nadia nina noah noor olena olga oliver omar otto pablo paul paula pavel pedro peter piet pierre priya rafael raj ravi rosa sanna sara selma
    signe simon sofia sophie stefan susan sven tariq tereza thomas tomas vera victor wanda wei yara yusuf zofia""".split()
)
FAMILY_ENDINGS = ("ski", "ska", "sky", "skaya", "berg", "quist", "mann", "ette", "eaux", "ovic", "ović", "evic", "ardi", "aldi", "uchi", "ashi", "enko", "ström", "strom", "hout", "escu", "sson", "son", "sen", "ez", "vich", "ova", "eva", "ini", "elli", "etti", "mura", "moto", "oglu", "yan", "ian", "dottir", "stein", "baum", "feld", "idis", "akis", "opoulos", "wicz", "czyk", "nen", "gaard", "lund", "strand", "ault", "ault", "ier", "ard", "ton", "well", "thy", "murthy", "appa", "wala")
#: Words of streets, firms, places and works, of which no name of a person consists.
THINGS = frozenset(
    """street st road rd lane ln avenue ave blvd boulevard drive court square terrace crescent row way hill park gardens bridge river lake mountain valley island bay beach station airport hospital clinic
    university college school institute church museum library hotel restaurant cafe bar club theatre theater cinema company corp inc ltd gmbh bank group press news times post journal magazine festival award
    prize cup league championship city town county state north south east west saint mount port new old great grand royal national international city lights nights days stories tales edition series volume part chapter
    straße strasse weg platz allee gasse rue chemin place quai calle avenida plaza paseo january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday""".split()
)
TITLES = frozenset("mr mrs ms miss dr prof professor sir lord lady madam captain judge officer sister brother uncle aunt frau herr mme mlle señor señora sr sra don doña signor signora".split())
NAME_CUES = re.compile(r"(?<!\w)(?:ask for|according to|neighbou?r|colleague|friend|manager|owner|author|teacher|doctor|nurse|belong(?:s|ed) to|contact:?|signed,?|goes by|name is|named|called|born|wrote|work(?:ed|s|ing)? (?:with|for)|met|speak (?:to|with)|talk(?:ed)? to|thanks? to|regards,?|sincerely,?|from|[—–-]|heiße|bei|appelle|nom de|nombre de|llamo|merci à|thank you,?|von|by|dear|with|and|to|und|y|et|;|[\"“(\[:])\s*$", re.I)
STRONG_CUES = re.compile(r"(?<!\w)(?:ask for|according to|my (?:neighbou?r|colleague|friend|boss|doctor|teacher|husband|wife|son|daughter|brother|sister|manager|landlord)|belong(?:s|ed) to|contact:|signed,|regards,|sincerely,|goes by|name is|am called|born|work(?:ed|ing) with|speak (?:to|with)|ich heiße|ich bin|liegt bei|frag(?:en sie|t|e)? nach|m'appelle|au nom de|a nombre de|me llamo|merci à|gracias a|thanks to|written by|attn:?|name:)\s*$", re.I)
PHONE_CUES = re.compile(r"\b(?:call|ring|phone|tel|telephone|mobile|cell|fax|text|whatsapp|signal|reach|line|number is|own is|dial|hotline|contact|anruf\w*|ruf\w*|telefon\w*|handy|téléphone|appelez|joindre|llam\w+|teléfono|móvil|numéro)\b", re.I)
ID_CUES = re.compile(r"\b(?:ssn|social security|security number|tax|taxpayer|tin|passport|licen[cs]e|national|insurance|nino|id|identity|identification|document|resident|citizen|passeport|ausweis\w*|reisepass\w*|documento|dni|nie|nif|cpf|curp|permis|steuer\w*|führerschein\w*|bsn|burgerservicenummer|sin|pesel|personnummer|aadhaar|pan|sécurité sociale|carte d'identité)\b", re.I)
OTHER_CUES = re.compile(r"\b(?:order|orders|tracking|code|model|version|isbn|issn|doi|coordinates|item|serial|invoice|ticket|tickets|measures|rated|written at|article|part|batch|sku|iban|account|konto|bic|swift|card|visa|reference|ref|case|bestell\w*|rechnung\w*|commande|facture|pedido|factura|cost|kostet|coûte|cuesta|seats?|minutes|page|vol|fig)\b[\s:#.]*(?:(?:number|no|nr|is|it|number is)[\s:.]*)?(?:doi:)?$", re.I)
ADDRESS_CUES = re.compile(r"\b(?:live at|lives at|living at|moved|address|ship|deliver|send|parcel|returned to|landlord|wohne|wohnt|vivo en|vive en|habite|livrez|envíen|paket|home|house|flat|apartment|to|lists|from|in der|in|at|contact)\b", re.I)
STREETS = r"street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|blvd\.?|boulevard|drive|dr\.?|court|ct\.?|place|pl\.?|square|terrace|crescent|close|row|way|walk|hill|park|gardens|mews|parade|quay"

_EMAIL = re.compile(
    r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"
    r"|(?<![\w.+%-])[\w.+%-]+\s?(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\])\s?[\w-]+(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\s?| dot )[\w-]+)+"
    r"|(?<![\w.+%-])[\w.+%-]+ at [\w-]+(?: dot [\w-]+)+",
    re.I,
)
_NUMBER = re.compile(
    r"(?<![\w-])(?:[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-Z]|[A-Z]{1,2}[0-9]{6,9}[A-Z]?)(?![\w-])"
    r"|(?<![\w-])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![\w-])"
    r"|(?<![\w@.+/-])(?:\+|\(|\b)?[0-9](?:[0-9 ()./‑ -]{5,22}[0-9])(?:[ -]?[A-Za-z](?![\w]))?(?![\w@])"
)
_ADDRESS = re.compile(
    rf"(?:(?:flat|apt|apartment|unit|suite|no)\.? ?[0-9]+[a-z]?, ?)?(?<![\w/.-])[0-9]{{1,4}}(?: ?(?:bis|ter)\b)?[a-z]?,? (?:(?:rue|avenue|boulevard|chemin|place|allée|quai|impasse|via|piazza)(?: (?:de|du|des|la|le))* [A-ZÀ-Ý][\w’'À-ÿ-]+|(?:[NSEW]\. )?[A-ZÀ-Ý][\w’'À-ÿ-]+(?: [A-ZÀ-Ý][\w’'À-ÿ-]+)?,? (?:{STREETS})\b)(?:,? ?(?:apt|apartment|flat|unit|suite|#)\.? ?[0-9]+[a-z]?\b)?"
    r"|\b[A-ZÀ-Ý][\wÀ-ÿ-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring)\s[0-9]{1,4}[a-z]?\b(?:, ?(?:wohnung|whg\.?|apt\.?) ?[0-9]+)?"
    r"|\b(?:calle|avenida|paseo|plaza|camino|c/)\s(?:de |del |la )*[A-ZÀ-Ý][\wÀ-ÿ-]+,? ?(?:n\.?º ?)?[0-9]{1,4}[a-z]?\b(?:, ?[0-9]+\.?º ?[a-z]?)?",
    re.I,
)
_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻŁŃŅŇŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_PART = rf"[{_UPPER}][\wÀ-ž’']*[a-zß-ž{_UPPER}](?:-[{_UPPER}][\wÀ-ž]+)*"
_NAME = re.compile(rf"(?<![\w@.-])(?:{_PART}),? (?:(?:[{_UPPER}]\.,? ?){{1,3}})?(?:{_PART})(?![\w@])|(?<![\w@.-])(?:[{_UPPER}]\. ?){{1,3}}{_PART}(?![\w@])|(?<![\w@.-]){_PART}, (?:[{_UPPER}]\.)(?: ?[{_UPPER}]\.)*")
_GIVEN_LOW = re.compile(r"(?<![\w@.-])(?:" + "|".join(sorted(GIVEN_NAMES)) + r")(?: [a-z]\.)? [a-zß-ž]{4,}(?:-[a-zß-ž]{4,})?(?![\w@])")
_SSN, _NINO, _DNI = re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}"), re.compile(r"[A-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]"), re.compile(r"[0-9]{8}[- ]?[A-Z]", re.I)
_PASS, _TAX, _INSEE = re.compile(r"[A-Z][0-9]{7,8}"), re.compile(r"[0-9]{2} [0-9]{3} [0-9]{3} [0-9]{3}"), re.compile(r"[12] [0-9]{2} [0-9]{2} [0-9]{2} [0-9]{3} [0-9]{3}(?: [0-9]{2})?")
_ID_SHAPES = (_SSN, _NINO, _DNI, _PASS, _TAX, _INSEE)
_NANP = re.compile(r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_INTL = re.compile(r"(?:\+|00)[0-9]{1,3}[ ./()-]?[0-9(][0-9 ./()-]{5,16}[0-9]")
_LOCAL = re.compile(r"0[0-9]{1,4}[ /.-][0-9][0-9 /.-]{4,12}[0-9]")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}\b|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}\b|(?:19|20)[0-9]{2}\s*[-–]\s*(?:19|20)[0-9]{2}$")
_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2} ?$")  # country and check digits of a bank account
_STOP = frozenset(
    """the a an this that these those my your his her its our their every another each some any no all if when while until because although before after behind beside beyond
    near inside without despite in on at of to from for with by and or but so yet then than what why how who where which whose did does do is are was were be been there here they
    we i you he she it nobody nothing one two three last next first as not never always signed contact born call ask according thanks regards dear my title summary text description
    abstract content review reviewtext score overall tag category article citation options question user assistant answer written ship please forward driving order tracking model
    der die das ein eine dieser diese dieses jede jeder jedes leider warum niemand ich wir sie er es obwohl wenn nach vor hinter unter frau herr mit für und oder aber
    le la les un une des ce cette ces chaque je tu il elle nous vous ils elles pourquoi quand personne malheureusement selon avant après sous merci à mme
    el los las una unos unas este esta estos cada yo él ella nosotros por para nadie cuando según creo detrás desde bajo en con y o pero señora señor reply mail id ssn towards""".split()
)


def _cue(text: str, start: int, width: int = 42) -> str:
    return text[max(0, start - width) : start]


def _name_words(span: str) -> list[str]:
    return [w for w in re.split(r"[\s,]+", span) if w]


def _family_like(word: str) -> bool:
    w = word.lower()
    return any(len(p) >= 5 and p.endswith(FAMILY_ENDINGS) for p in w.split("-"))


def _email_candidates(text: str) -> Iterator[tuple]:
    for m in _EMAIL.finditer(text):
        s, e = m.span()
        span = m.group()
        if span[-1:] in "-_":
            e -= 1
        plain = "@" in span
        spelled = not plain and re.search(r"[(\[{<](?:at|@)[)\]}>]", span, re.I) is not None
        loose = not plain and not spelled
        dots = re.search(r"[.]|dot", span.partition("@")[2] or span, re.I) is not None
        votes = (1 if plain and dots else 0, 1 if spelled else 0, (1 if re.search(r" dot ", span, re.I) else -1) if loose else 0)
        yield "email", s, e, votes, "plain" if plain else ("spelled" if spelled else "loose")


def _number_candidates(text: str) -> Iterator[tuple]:
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        span = text[s:e]
        if span[0] == "(" and ")" not in span:
            s, span = s + 1, span[1:]
        if span[0] != "(" and span.count("(") != span.count(")"):
            continue
        digits = sum(c.isdigit() for c in span)
        if digits < 7 and not _NINO.fullmatch(span):
            continue
        letter = span[-1].isalpha()
        if letter and not any(p.fullmatch(span) for p in _ID_SHAPES):
            cut = re.match(r"(.*[0-9])[ -]?[A-Za-z]$", span)
            span, e, letter = cut.group(1), s + len(cut.group(1)), False
        before, after = _cue(text, s), text[e : e + 30]
        id_shape = next((k for k, p in enumerate(_ID_SHAPES) if p.fullmatch(span)), None)
        nanp, intl, local = _NANP.fullmatch(span) is not None, _INTL.fullmatch(span) is not None, _LOCAL.fullmatch(span) is not None
        other = OTHER_CUES.search(before) is not None
        date = _DATE.match(span) is not None or re.match(r":[0-9]", after) is not None or _ACCOUNT.search(before) is not None
        phone_cue, id_cue = PHONE_CUES.search(before) is not None, ID_CUES.search(before[-34:]) is not None
        is_phone = nanp or intl or local
        marks = f"{'i' if id_shape is not None else '-'}{'n' if nanp else '-'}{'+' if intl else '-'}{'0' if local else '-'}"
        if not span[0].isalpha() and not letter:
            yield (
                "phone", s, e,
                (1 if nanp else 0, 1 if intl else 0, 1 if local else 0, 1 if phone_cue else 0, -1 if other else 0, -1 if id_shape is not None and not intl else 0, -1 if date else 0, 1 if is_phone and 9 <= digits <= 14 else -1),
                marks,
            )
        if not (span[0] in "+("):
            yield (
                "id_number", s, e,
                (1 if id_shape is not None else (0 if id_cue else -1), 1 if id_shape in (0, 1, 5) else 0, 1 if id_cue else (-1 if id_shape is None else 0), -1 if other else 0, -1 if (intl or nanp or local) and id_shape is None else 0, -1 if date else 0, -1 if phone_cue and id_shape is None else 0),
                f"{id_shape}",
            )


def _address_candidates(text: str) -> Iterator[tuple]:
    for m in _ADDRESS.finditer(text):
        s, e = m.span()
        span = m.group()
        # street words must be capitalised like names, unless the whole passage is in capitals or in lower case
        core = re.findall(r"[^\W\d_]{3,}", span)
        named = any(w[0].isupper() for w in core)
        before = _cue(text, s)
        votes = (1 if re.search(r"[0-9]", span) else -1, 1 if ADDRESS_CUES.search(before) else 0, 1 if re.search(r"\b(?:flat|apt|bis|ter)\b", span, re.I) else 0, 1 if named else -1, -1 if re.search(r"\b(?:there were|after|for|weighs|chapter|item|no\.|vol\.)\s*$", before, re.I) else 0, 1 if re.search(rf"(?:{STREETS}|rue|avenue|calle|straße|strasse|weg|gasse|platz)\b", span, re.I) else 0)
        yield "address", s, e, votes, "n" if named else "-"


def _name_candidates(text: str) -> Iterator[tuple]:
    at = 0
    while m := _NAME.search(text, at):
        s, e = m.span()
        span = m.group()
        at = e
        parts = _name_words(span)
        bare = [p for p in parts if not re.fullmatch(rf"[{_UPPER}]\.?", p)]
        first = parts[0]
        low = [p.lower().rstrip(".,") for p in bare]
        # a cue or other common word is no part of a name: go on behind it
        if low and (low[0] in _STOP or low[0] in TITLES):
            at = s + len(first) + 1
            continue
        if len(low) > 1 and (low[-1] in _STOP or low[-1] in TITLES):
            at = max(s + len(first) + 1, m.end() - len(bare[-1]))
            continue
        before, after = _cue(text, s), text[e : e + 3]
        comma = "," in span
        given = any(w.split("-")[0] in GIVEN_NAMES for w in low)
        family = any(_family_like(w) and w not in GIVEN_NAMES for w in low)
        word = re.search(r"\b(\w+)\.?\s*$", before)
        votes = (
            1 if given else 0,
            1 if family else 0,
            1 if STRONG_CUES.search(before) else 0,
            1 if NAME_CUES.search(before) else 0,
            1 if word and word.group(1).lower() in TITLES else 0,
            -1 if after[:2] in ("'s", "’s") or after[:1] == "@" or any(p.endswith(("'s", "’s", "'S", "’S")) for p in parts) else 0,
            -1 if re.search(r"\b(?:film|book|movie|novel|street|shops? (?:on|in)|product|album|band|song|brand|city|town|village|of|in|near|from the|the|a|an)\s*$", before, re.I) else 0,
            -1 if comma and not given else 0,
            -1 if THINGS.intersection(low) else 0,
        )
        yield "name", s, e, votes, f"{'c' if comma else 's'}{'i' if len(parts) > len(bare) else '-'}{len(bare)}"
        if comma and not given:
            at = s + len(first) + 1  # perhaps the name begins behind the comma
    for m in _GIVEN_LOW.finditer(text):
        family = _family_like(m.group().split()[-1])
        before = _cue(text, m.start())
        yield "name", m.start(), m.end(), (1, 1 if family else -1, 1 if STRONG_CUES.search(before) else 0, 0, 0, 0, 0, 0 if family else -1, 0), "low"


_ANY_NUMBER = re.compile(r"[0-9][0-9 ()./-]{4,}[0-9]|[A-Z][0-9]{7}|[0-9]{8}")


def candidates(text: str) -> list[tuple]:
    """Spans that may be personal information: (type, start, end, votes, marks)."""
    found: list[tuple] = []
    folded = text
    if "@" in folded or " at " in folded.lower() or re.search(r"[(\[{<]at[)\]}>]", folded, re.I):
        found += _email_candidates(text)
    if _ANY_NUMBER.search(text):
        found += _number_candidates(text)
    if re.search(r"[0-9]", text):
        found += _address_candidates(text)
    found += _name_candidates(text)
    return found


#: Characters before and behind a span that the classifier sees, size of its table of weights, and the share of a labeler's
#: list that is withheld in training, so that spans of unlisted words are decided by their form and surroundings.
BEFORE, BEHIND, BITS = 40, 14, 17
#: Votes that stem from lists, by type; withheld in half of the training rows.
LISTED = {"name": (0, 1), "id_number": (0, 1), "address": (5,), "phone": (0, 1, 2), "email": ()}
#: Places for examples of each vote pattern in the sample that the classifier is fitted on.
PLACES = 16
STEPS, RATE, PENALTY = 300, 0.3, 1e-3
#: Weight of a vote before anything is learned.
VOTE, BIAS = 1.6, -0.4

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]")
_LETTERS = re.compile(r"[^\W\d_]{3,}")


def pattern(kind: str, votes: tuple, marks: str) -> str:
    return f"{kind}|{','.join(map(str, votes))}|{marks}"


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) & ((1 << BITS) - 1)


def case_counts(words: Counter) -> Counter:
    """How often words stand in lower case and with a capital, by place in a table of fixed size (`2 * place + capital`)."""
    found: Counter = Counter()
    for w, n in words.items():
        if w.islower():
            found[2 * place(w)] += n
        elif w[1:].islower():
            found[2 * place(w.lower()) + 1] += n
    return found


def commonness(span: str, table: np.ndarray | None) -> int:
    """Vote of the corpus on a name: -1 if one of its words mostly stands in lower case, 1 if none ever does, else 0."""
    if table is None:
        return 0
    votes = []
    for w in _LETTERS.findall(span.lower()):
        low, capital = table[place(w)]
        votes.append(-1 if low >= 2 and low >= 0.3 * (low + capital) else (1 if capital >= 1 and low <= 0.02 * capital else 0))
    return min(votes, default=0)


def all_votes(c: tuple, table: np.ndarray | None) -> tuple:
    """A candidate's votes, for names with that of the corpus; the ending of a common word says nothing."""
    if c[0] != "name":
        return c[3]
    corpus = commonness(c[6], table)
    return (c[3][0], c[3][1] if corpus >= 0 else 0, *c[3][2:], corpus)


def shape(span: str) -> str:
    """Form of a span: runs of capitals, small letters and digits (with their number), and the signs between them."""
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 12)}", re.sub(r"[^\W\d_]+", lambda m: ("X" if m.group().isupper() else "x" if m.group().islower() else "Xx"), span))[:40]


def features(kind: str, votes: tuple, marks: str, before: str, span: str, behind: str) -> list[str]:
    """What the classifier sees of a span: votes, marks, shape, its words' ends, and the words and signs around it."""
    out = [f"{kind}v{i}{v:+d}" for i, v in enumerate(votes) if v]
    left, right = _TOKEN.findall(before.casefold())[-3:], _TOKEN.findall(behind.casefold())[:2]
    left = ["9" if t.isdigit() else t for t in ["^", "^", "^", *left][-3:]]
    right = ["9" if t.isdigit() else t for t in [*right, "$"]]
    joined = f"{before[-1:].isspace()}{behind[:1].isspace()}"
    out += [f"{kind}m{marks}", f"{kind}s{shape(span)}", f"{kind}l{left[-1]}", f"{kind}l2{left[-2]} {left[-1]}", f"{kind}l3{left[-3]} {left[-2]} {left[-1]}", f"{kind}n{left[-2]}", f"{kind}r{right[0]}", f"{kind}j{joined}"]
    if kind == "name":
        own = [w.casefold() for w in _LETTERS.findall(span)]
        out += [f"names{w[-k:]}" for w in own for k in (2, 3, 4)] + [f"namep{w[:3]}" for w in own] + [f"namec{len(own)}"]
    elif kind in ("address", "email"):
        out += [f"{kind}w{w.casefold()[-6:]}" for w in _LETTERS.findall(span)]
    else:
        out.append(f"{kind}d{min(20, sum(c.isdigit() for c in span))}")
    return out


class SpanClassifier:
    """Reliabilities of the labelers by expectation-maximisation over all vote patterns, then a logistic regression on spans.

    The regression is fitted to the posteriors of the label model. It sees the votes, but also the span's form and words
    and what stands around it; as listed votes are withheld in half of its rows, it can accept what no list has.
    """

    def __init__(self, counts: dict[str, float], examples: list[tuple[str, float, tuple[str, str, str]]], table: np.ndarray | None = None):
        """counts: vote patterns of all texts; examples: pattern, weight and (before, span, behind) of a bounded sample; table: case_counts."""
        self.table = table
        soft: dict[str, float] = {}
        for kind in TYPES:
            own = [(p, n) for p, n in sorted(counts.items()) if p.startswith(kind + "|")]
            if own:
                votes = np.array([[int(v) for v in p.split("|")[1].split(",")] for p, _ in own])
                soft.update(zip([p for p, _ in own], self._reliabilities(votes, np.array([c for _, c in own], dtype=float)).tolist()))
        self.soft = soft
        self.weights = self._fit(soft, examples)

    @staticmethod
    def _reliabilities(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Posterior of each pattern; a labeler's votes depend on the true class only."""
        total = votes.sum(axis=1)
        p = 1 / (1 + np.exp(-VOTE * total - BIAS))
        for _ in range(ROUNDS):
            prior = np.clip((p * n).sum() / n.sum(), 0.01, 0.99)
            odds = np.full(len(n), np.log(prior / (1 - prior)))
            for k in range(votes.shape[1]):
                for v in (-1, 0, 1):
                    is_v = votes[:, k] == v
                    if is_v.any():
                        # a few pseudo counts say that a labeler is right more often than not
                        yes = ((p * n)[is_v].sum() + (2.0 if v == 1 else 0.5 if v == 0 else 0.1)) / ((p * n).sum() + 2.6)
                        no = (((1 - p) * n)[is_v].sum() + (2.0 if v == -1 else 0.5 if v == 0 else 0.1)) / (((1 - p) * n).sum() + 2.6)
                        step = np.log(yes / no)
                        step = max(step, 0.0) if v == 1 else (min(step, 0.0) if v == -1 else np.clip(step, -1.0, 1.0))
                        odds[is_v] += step
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return p

    @staticmethod
    def _fit(soft: dict[str, float], examples: list[tuple[str, float, tuple[str, str, str]]]) -> np.ndarray:
        """Weights by feature place: the regression's, drawn towards those of a plain vote."""
        start = np.zeros(1 << BITS)
        for kind in TYPES:
            start[place(f"{kind}b")] = BIAS
            for i in range(14):
                start[place(f"{kind}v{i}+1")], start[place(f"{kind}v{i}-1")] = VOTE, -VOTE
        row, column, target, weight = [], [], [], []
        for p, n, around in examples:
            kind, votes, marks = p.split("|", 2)
            votes = tuple(int(v) for v in votes.split(","))
            listed = LISTED[kind]
            for withheld in (False, True):
                if withheld and not any(votes[i] for i in listed):
                    continue
                seen = tuple(0 if withheld and i in listed else v for i, v in enumerate(votes))
                places = {place(f"{kind}b"), *map(place, features(kind, seen, marks, *around))}
                row += [len(target)] * len(places)
                column += places
                target.append(soft.get(p, 0.5))
                weight.append(n**0.5 * (0.5 if withheld else 1.0))
        if not target:
            return start
        row, column, y, weight = np.array(row), np.array(column), np.array(target), np.array(weight)
        weight = weight / weight.mean()
        w, size = start.copy(), np.full(1 << BITS, 1e-8)
        for _ in range(STEPS):
            q = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[column], minlength=len(y)), -30, 30)))
            slope = np.bincount(column, weights=(weight * (q - y))[row], minlength=1 << BITS) + PENALTY * len(y) ** 0.5 * (w - start)
            size += slope**2
            w -= RATE * slope / np.sqrt(size)
        return w

    def score(self, c: tuple) -> float:
        """Log odds that a candidate (type, start, end, votes, marks, before, span, behind) is personal information."""
        return float(self.weights[[place(f"{c[0]}b"), *{place(f) for f in features(c[0], all_votes(c, self.table), *c[4:])}]].sum())

    def pick(self, found: list[tuple]) -> list[tuple[str, int, int]]:
        """Candidates scored above one half; of overlapping ones the better, then the longer."""
        good = [(self.score(c), c) for c in found]
        good = sorted(((s, c) for s, c in good if s > 0), key=lambda x: (TYPES.index(x[1][0]) > 0, -round(x[0], 1), x[1][1] - x[1][2], x[1][1]))
        taken: list[tuple[str, int, int]] = []
        for _, c in good:
            if all(c[2] <= a or c[1] >= b for _, a, b in taken):
                taken.append((c[0], c[1], c[2]))
        return sorted(taken, key=lambda x: x[1])

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        return self.pick(surrounded(text))


def surrounded(text: str) -> list[tuple]:
    """The candidates of a text with what stands before them, themselves, and what stands behind."""
    return [(k, s, e, v, m, text[max(0, s - BEFORE) : s], text[s:e], text[e : e + BEHIND]) for k, s, e, v, m in candidates(text)]


def personal_fields(items: DataFrame, samples: DataFrame) -> DataFrame:
    """The texts to look at, one row per field and record (`field`, `row_id`, `text`)."""
    part = lambda df, field, key, column: df.where(F.col(column).isNotNull()).select(F.lit(field).alias("field"), F.col(key).alias("row_id"), F.col(column).alias("text"))
    return (
        part(items, "dataset_item.profile_text", "sample_idx", "profile_text")
        .unionByName(part(items, "dataset_item.output", "sample_idx", "output"))
        .unionByName(part(samples, "text_generation_sample.user_profile", "sample_id", "user_profile"))
    )


def read_candidates(texts: DataFrame) -> DataFrame:
    """One pass over all texts: the candidates of each text that has any (`what` = 0, `field`, `row_id`, `packed`), and how often words
    stand in lower case or with a capital (`what` = 1, `k`, `n`). Written once, so that no expression runs over a text twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[bytes | None, list[str]]] = {}
        for batch in batches:
            words: Counter = Counter()
            fields, ids, packed = [], [], []
            for field, row, t in zip(batch["field"], batch["row_id"], batch["text"]):
                if t not in known:
                    if len(known) > 5_000:
                        known.clear()
                    found = surrounded(t)
                    known[t] = marshal.dumps(found) if found else None
                    words.update(_LETTERS.findall(_EMAIL.sub(" ", t) if found and found[0][0] == "email" else t))  # a text that a task meets again counts once
                if known[t] is not None:
                    fields.append(field)
                    ids.append(row)
                    packed.append(known[t])
            cases = case_counts(words)
            n = len(fields)
            blank = [None] * len(cases)
            held = {"field": fields + blank, "row_id": ids + blank, "packed": packed + blank}
            yield pd.DataFrame({"what": [0] * n + [1] * len(cases), **{k: pd.Series(v, dtype="object") for k, v in held.items()}, "k": [0] * n + list(cases), "n": [0] * n + list(cases.values())})

    schema = "what int, field string, row_id long, packed binary, k long, n long"
    return durable(spread(texts.select("field", "row_id", "text")).mapInPandas(run, schema))


def fit_classifier(read: DataFrame) -> SpanClassifier:
    """The classifier, from the candidates of all texts.

    The counts of vote patterns and of words are of all texts and combined before they leave the executors. The regression is
    fitted on a bounded sample: of each of the PATTERNS most frequent patterns at most PLACES examples, by digest.
    """
    table = np.zeros((1 << BITS, 2))
    for r in read.where("what = 1").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most two rows per place
        table[r["k"] // 2, r["k"] % 2] = r["n"]
    shared = read.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, int], list] = {}
            for p in batch["packed"]:
                for c in marshal.loads(p):
                    votes = all_votes(c, shared.value)
                    h = zlib.crc32("\t".join(c[5:]).encode("utf-8", "replace"))
                    own = found.setdefault((pattern(c[0], votes, c[4]), h % PLACES), [0, h, c[5:]])
                    own[0] += 1
                    if h < own[1]:
                        own[1:] = [h, c[5:]]
            yield pd.DataFrame([(p, slot, n, h, *c) for (p, slot), (n, h, c) in found.items()], columns=["p", "slot", "n", "h", "a", "s", "b"]).astype({"slot": "int32", "n": "int64", "h": "int64"})

    examples = read.where("what = 0").select("packed").mapInPandas(run, "p string, slot int, n long, h long, a string, s string, b string")
    examples = durable(examples.groupBy("p", "slot").agg(F.sum("n").alias("n"), F.min(F.struct("h", "a", "s", "b")).alias("x")))
    per_pattern = examples.groupBy("p").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "x")).alias("all"))  # at most PLACES of each
    rows = per_pattern.orderBy(F.desc("n"), "p").limit(PATTERNS).collect()
    seen = sorted((r["p"], float(e["n"]), (e["x"]["a"], e["x"]["s"], e["x"]["b"])) for r in rows for e in r["all"])
    return SpanClassifier({r["p"]: float(r["n"]) for r in rows}, seen, table)


def find_personal(texts: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """Every mention of personal information (`field`, `row_id`, `pii_type`, `start_pos`, `end_pos`) in texts (`field`, `row_id`, `text`).

    Regular expressions propose spans; labelers (shapes, gazetteers of names and endings, cue words, counter-cues, the corpus'
    own lower-case words) vote on each. Expectation-maximisation over the vote patterns of all texts estimates how far each
    labeler can be trusted; a logistic regression on votes, form, words and surroundings, fitted to its posteriors on a bounded
    sample of spans, decides. Positions are code points, the end exclusive; mentions in a text do not overlap. Null and
    empty texts give no row; texts of any length are read whole; repeated rows give repeated mentions; an empty table gives
    no row.
    """
    read = read_candidates(texts)
    shared = texts.sparkSession.sparkContext.broadcast(model or fit_classifier(read))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, list] = {}
        for batch in batches:
            out = []
            for field, row, p in zip(batch["field"], batch["row_id"], batch["packed"]):
                found = known.get(p)
                if found is None:
                    if len(known) > 5_000:
                        known.clear()
                    found = known[p] = shared.value.pick(marshal.loads(p))
                out += [(field, row, kind, s, e) for kind, s, e in found]
            yield pd.DataFrame(out, columns=["field", "row_id", "pii_type", "start_pos", "end_pos"]).astype({"row_id": "int64", "start_pos": "int64", "end_pos": "int64"})

    return read.where("what = 0").select("field", "row_id", "packed").mapInPandas(run, "field string, row_id long, pii_type string, start_pos long, end_pos long")


def redact(texts: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """The texts with typed placeholders such as [NAME] in place of personal information; everything else stays as it is.

    Equal mentions of a text get the same number, so the text stays readable: [NAME_1] … [NAME_2] … [NAME_1]. The texts
    are read again rather than written with their candidates or shuffled to meet them.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model or fit_classifier(read_candidates(texts)))

    def clean(text: str) -> tuple[str, int]:
        out, at, numbers = [], 0, {}
        spans = shared.value.spans(text)
        for kind, s, e in spans:
            own = numbers.setdefault(kind, {})
            out += [text[at:s], f"[{kind.upper()}_{own.setdefault(text[s:e].casefold(), len(own) + 1)}]"]
            at = e
        return "".join([*out, text[at:]]), len(spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, int]] = {}
        for batch in batches:
            done = []
            for t in batch["text"]:
                if t not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[t] = clean(t)
                done.append(known[t])
            yield pd.DataFrame({"field": batch["field"].to_numpy(), "row_id": batch["row_id"].to_numpy(), "text": [t for t, _ in done], "n_found": [n for _, n in done]})

    return spread(texts.select("field", "row_id", "text")).mapInPandas(run, "field string, row_id long, text string, n_found long")
