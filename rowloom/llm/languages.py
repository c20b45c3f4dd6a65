"""Language of short texts by script and function words."""

from __future__ import annotations

import re

#: Function words that tell Latin-script languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is it that was for on with as at by this from they his her their its my our your every another she he we you but not are were be been has had have who which what when while until because if then than so yet there after before behind beside beyond near inside without despite although did does do an or about into over only never always would could should will can one all no some other more each them him me us",
    "de": "der die das und ist nicht ein eine einen einem einer eines den dem des im am zu mit auf für von sich auch aus bei nach wie als aber oder wenn weil dass durch über unter gegen ohne um bis seit während laut trotz hinter neben vor jede jeder jedes jeden diese dieser dieses diesen ich du er sie es wir ihr mein sein kaum so gern niemand warum wo obwohl leider finde kann habe hat sind war werden wird noch nur mehr sehr keine kein",
    "fr": "le la les un une des du de et est ne pas que qui dans pour sur avec ce cette ces chaque je tu il elle nous vous ils elles au aux se sa son ses leur mais ou où donc car si comme plus sans sous par vers chez après avant pendant depuis devant derrière malgré contre près selon personne pourquoi quand quelle malheureusement trouve mon ma mes votre sont était être avoir ont même très",
    "es": "el la los las un una unos unas de del y es no que en con por para su sus se lo al como más pero este esta estos estas cada yo tú él ella nosotros ellos mi tu nuestra o si porque cuando donde según sin sobre entre hasta desde detrás delante durante después antes bajo contra cerca nadie hay creo gran fin pesar desgracia también muy son era fue ser está están le les me",
}

_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile("[぀-ヿ]")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")
_THAI = re.compile("[฀-๿]")
_DEVANAGARI = re.compile("[ऀ-ॿ]")
_HANGUL = re.compile("[가-힯]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_ARABIC = re.compile("[؀-ۿ]")
_SPLIT = re.compile(r"(?<=[.!?。！？।])[\s\"'”’»)\]」』]*|\n+")
_WEIGHT: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list.split():
        _WEIGHT.setdefault(_w, []).append(_lang)


def sentence_language(text: str) -> tuple[str | None, float]:
    """Language of one sentence (None: can't tell) and its weight in words."""
    if not text.isascii():
        for lang, pattern in (("ja", _KANA), ("ko", _HANGUL), ("th", _THAI), ("hi", _DEVANAGARI), ("ru", _CYRILLIC), ("ar", _ARABIC)):
            n = len(pattern.findall(text))
            if n >= 2:
                han = len(_HAN.findall(text)) if lang == "ja" else 0
                letters = sum(map(len, _WORD.findall(text)))
                if (n + han) * 2 >= letters:
                    return lang, (n + han) / 2
        han = len(_HAN.findall(text))
        if han >= 2 and han * 2 >= sum(map(len, _WORD.findall(text))):
            return "zh", han / 2
    words = [w for w in _WORD.findall(text.lower())]
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in words:
        langs = _WEIGHT.get(w)
        if langs:
            for lang in langs:
                score[lang] += 1 / len(langs)
    best = max(score, key=score.get)
    rest = max(v for k, v in score.items() if k != best)
    if score[best] < 1.5 or score[best] < 1.3 * rest or score[best] < 0.12 * len(words):
        return None, float(len(words))
    return best, float(len(words))


def language_shares(text: str) -> dict[str, float]:
    """Words by language, over the sentences of a text; sentences of no clear language are left out."""
    shares: dict[str, float] = {}
    for part in _SPLIT.split(text):
        if part:
            lang, weight = sentence_language(part)
            if lang:
                shares[lang] = shares.get(lang, 0.0) + weight
    return shares
