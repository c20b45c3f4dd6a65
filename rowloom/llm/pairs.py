"""Broken prompt and response pairs: empty, truncated, refusing, copying and wrong-language answers."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.languages import FUNCTION_WORDS, language_shares
from rowloom.llm.words import lcs_length, says_nothing, strip_markup, units
from rowloom.operators.skew import join_small
from rowloom.session import durable

#: Words per shingle of the copy test, and the share of an answer's shingles that must stand in its prompt.
SHINGLE, CONTAINED = 3, 0.5
#: Share of the longer of answer and prompt text that must align for a copy.
COPIED = 0.8
#: Share of a sentence and of a template that must align for a refusal.
REFUSED = 0.75
#: Sources up to which their share of prose answers is broadcast; more are joined by shuffling.
FEW_SOURCES = 10_000

#: Refusal templates. {o} stands for an opening, which may be missing.
OPENINGS = {
    "en": ["sorry", "i'm sorry but", "i am sorry but", "unfortunately", "thank you for asking but", "i apologize however", "i apologize but", "my apologies", "as a language model", "as an ai language model", "as an ai", "no", "i'm afraid", "i am afraid", "i regret that", "apologies", "regrettably"],
    "de": ["es tut mir leid aber", "es tut mir leid", "leider", "entschuldigung", "bedaure", "ich bedaure", "als sprachmodell", "als ki"],
    "fr": ["je suis désolé mais", "je suis désolée mais", "désolé", "désolée", "navré", "je regrette", "malheureusement", "en tant que modèle de langage"],
    "es": ["lo siento pero", "lo siento", "lo lamento", "lamentablemente", "por desgracia", "como modelo de lenguaje"],
}
REFUSALS = {
    "en": [
        "i must decline to answer", "i cannot provide an answer to this", "i won't be able to comply with this request", "it would not be appropriate for me to respond to this", "i'm not able to write this for you",
        "i don't have the ability to answer questions like this one", "i can't help with that request", "i do not feel comfortable continuing with this", "this is something i am unable to assist with", "answering it is not possible for me",
        "content of this kind is not something i produce", "there is nothing i can say about this topic", "the requested text can't be generated", "i'd rather not respond here", "i have to pass on this one",
        "that is outside of what i am allowed to write", "this request goes against my usage rules so i will stop here", "my guidelines rule this out", "i cannot assist with that", "i can't assist with that request",
        "i am unable to help with this request", "i'm unable to answer that", "i cannot fulfill this request", "i can't answer that question", "i will not answer this question", "i refuse to answer this", "i cannot comply with that",
        "i'm not comfortable answering this", "i cannot help you with that", "i am not able to provide that information", "i can't provide that information", "i cannot generate that content", "that is against my policy",
    ],
    "de": ["ich kann dabei nicht helfen", "kann ich dabei nicht helfen", "ich kann das nicht beantworten", "darf ich diese anfrage nicht beantworten", "ich kann diese frage nicht beantworten", "das kann ich nicht beantworten", "ich kann dieser bitte nicht nachkommen", "ich kann diese anfrage nicht erfüllen", "dazu kann ich nichts sagen", "ich darf dazu nichts sagen", "ich darf das leider nicht schreiben", "bin ich nicht in der lage das zu schreiben", "ich kann das nicht schreiben"],
    "fr": ["je ne suis pas en mesure de vous aider", "je ne peux pas répondre à cette demande", "je ne peux pas répondre à cette question", "je ne peux pas vous aider", "il m'est impossible de répondre", "je dois refuser de répondre", "je ne suis pas autorisé à répondre à cela", "je ne peux pas satisfaire cette demande"],
    "es": ["no puedo ayudarte con esa petición", "no me es posible responder a esto", "no puedo responder a esta pregunta", "no puedo ayudarle con eso", "no puedo cumplir con esta solicitud", "debo negarme a responder", "no estoy autorizado a responder", "no puedo responder a eso"],
    "zh": ["抱歉我无法回答这个问题", "很抱歉我无法回答这个问题", "对不起我无法回答这个问题", "抱歉我不能帮助你完成这个请求", "抱歉我无法满足这个请求", "很抱歉我不能提供这方面的帮助", "作为语言模型我无法回答这个问题", "作为一个语言模型我不能回答", "我无法协助处理这个请求", "抱歉这个问题我不方便回答", "恕我不能回答"],
    "ja": ["申し訳ありませんがお答えできません", "申し訳ありませんがその質問にはお答えできません", "申し訳ございませんがそのご要望にはお応えできません", "すみませんがそれには答えられません", "言語モデルとしてこの質問には答えられません", "残念ながらお手伝いできません", "そのリクエストにはお応えできません", "この依頼には対応できません", "回答は控えさせていただきます"],
}
#: Words that refusals are made of, in the spelling of `units`: of denial, of declining (a denial and an act at once), of
#: answering, of the speaker, and light ones that may stand between them.
REFUSAL_WORDS = {
    "en": {
        "deny": "not t cannot never unable unwilling impossible nothing against outside beyond off",
        "decline": "refuse refusing decline declining refrain abstain pass turn reject skip sit",
        "act": "help assist answer answering respond responding reply replying comply fulfil fulfill provide providing write writing generate generating produce producing create creating discuss discussing talk talking speak speaking comment commenting engage engaging continue continuing do handle complete address support process share sharing offer give giving say deal cover explain grant meet accommodate limits bounds scope policy guidelines rules abilities capabilities answerable",
        "self": "i we my me our us",
        "light": "can could won will would ll d m am is are be been was do don doesn didn couldn wouldn shouldn mustn isn able to going want wanting wish prefer rather must have need allowed permitted authorized authorised prepared comfortable feel feeling in a an the at on with for from about you your of this that it its these those here any anything something some such kind type sort one all really just simply possibly currently right now further out no way position what which as so too and or but by there ability something afraid sorry may shall should ought like down up into question questions request requests prompt task content topic subject text information matter message inquiry query answer response reply instruction instructions material story essay ones regret unfortunately however personally",
    },
    "de": {
        "deny": "nicht nichts kein keine keinen keinem keiner unmöglich außerstande",
        "decline": "ablehnen verweigern lehne verweigere unterlassen absehen passe passen weigere",
        "act": "beantworten antworten antwort helfen weiterhelfen hilfe behilflich schreiben sagen erfüllen nachkommen bearbeiten liefern verfassen eingehen geben erledigen unterstützen äußern sprechen reden auskunft mitteilen erstellen erzeugen anbieten tun machen dienen",
        "self": "ich wir mir uns mein meine meiner",
        "light": "kann können darf dürfen möchte will werde könnte muss müssen bin ist sind wäre habe hier hierzu dazu dabei darauf darüber davon damit das dies diese diesem diesen dieser dieses die der den dem ein eine einer einen es zu zur zum auf mit bei für von über in aus leider dir ihnen dich sie ihre ihren ihrer deine deinen deiner frage fragen anfrage bitte aufgabe thema inhalt inhalte text wunsch wünschen lage so etwas solche solchen weiter ab mich nur auch jetzt befugt berechtigt bereit erlaubt möglich",
    },
    "fr": {
        "deny": "pas rien impossible incapable aucun aucune",
        "decline": "refuse refuser décline décliner abstenir abstiens",
        "act": "répondre aider traiter satisfaire fournir écrire rédiger dire donner parler aborder commenter assister accéder faire discuter produire générer continuer donner suite partager proposer",
        "self": "je j nous m me moi mon ma",
        "light": "ne n peux puis pouvons saurais souhaite veux dois pourrai pourrais préfère préférerais suis sommes est serait en de d à au aux ce cet cette ces cela ça c le la les l un une vous te votre vos ta ton sujet question demande requête tâche thème contenu texte message mesure capable autorisé autorisée possible il y sur avec pour dans plus malheureusement désolé désolée navré navrée genre type ici que qui",
    },
    "es": {
        "deny": "no nada imposible incapaz ninguna ningún tampoco",
        "decline": "rechazar rechazo negarme niego abstenerme abstengo declinar declino",
        "act": "responder ayudar ayudarte ayudarle ayudarles ayuda contestar cumplir escribir generar proporcionar ofrecer hablar tratar comentar atender hacer decir dar seguir compartir discutir producir continuar",
        "self": "yo me mi nosotros puedo podemos quiero debo voy podré podría deseo prefiero tengo estoy soy niego",
        "light": "es está sería posible permitido permitida autorizado autorizada capaz en condiciones a al con de del sobre esta este esto esa ese eso estas estos la el lo los las un una tu su te le les pregunta petición solicitud tema tarea contenido texto asunto consulta para que ir tipo aquí más lamentablemente siento",
    },
}
#: The same for Chinese and Japanese, as parts of the text; a refusal has a denial and little that is none of these.
REFUSAL_PARTS = {
    "zh": {"deny": "无法|無法|不能|不便|不可以|不会|不想|不方便|没办法|没有办法|拒绝|恕不|难以|不允许", "act": "回答|帮助|幫助|协助|協助|提供|满足|处理|讨论|完成|回应|生成|帮忙|解答|谈论|评论|撰写|写|说|做|拒绝|支持|答复", "light": "很抱歉|抱歉|对不起|我们|我|您|你|这个|这类|这样|这|此|该|那|的|了|是|对|为|就|在|和|与|给|关于|有关|任何|方面|内容|问题|请求|要求|话题|任务|信息|答案|只能|只好|必须|恕|也|再|来|去|到|进行|被|请|谅解"},
    "ja": {"deny": "できません|できかね|いたしかね|しかね|出来ません|られません|えません|ません|控え|お断り|できない|不可能", "act": "お答え|回答|お手伝い|手伝|対応|お応え|答え|提供|協力|お力に|控え|お断り|手助け|説明|話|書|生成|作成|コメント", "light": "申し訳ありません|申し訳ございません|すみません|ごめんなさい|残念ながら|恐れ入りますが|私|わたし|この|その|ご|こちら|それ|これ|質問|要望|依頼|リクエスト|話題|内容|件|について|に関して|する|こと|こたえ|もの|ため|ので|から|ます|いたし|させて|いただき|いただく|いただけ|おります|です|が|は|に|を|で|の|と|も|へ|には|し|た|て|な|く|ん|ね|お|お客様|よう"},
}
#: Sentences that may stand beside a refusal.
CLOSINGS = ["is there anything else i can do for you", "please consult a professional", "try asking about something different", "gibt es sonst noch etwas", "puis je faire autre chose", "hay algo más", "还有其他需要帮助的吗", "他に何かお手伝いできますか", "please ask me something else", "let me know if you need anything else"]
#: How a sentence behind a refusal begins that gives an answer after all, and words that may stand before it.
ANSWERING = ["here is", "here's", "here are", "the answer is", "hier ist", "hier sind", "die antwort ist", "die antwort lautet", "voici", "la réponse est", "aquí está", "aquí tienes", "aquí están", "la respuesta es", "以下是", "答案是", "以下は", "答えは"]
TURNING = ["but", "however", "that said", "still", "instead", "aber", "trotzdem", "mais", "cependant", "pero", "sin embargo", "但", "不过", "ただし"]
#: Names of languages in prompts that ask for an answer in one.
LANGUAGE_NAMES = {
    "en": "english|englisch\\w*|anglais\\w*|inglés|英语|英文|英語",
    "de": "german|deutsch\\w*|allemand\\w*|alemán|德语|德文|ドイツ語",
    "fr": "french|französisch\\w*|français\\w*|francés|法语|法文|フランス語",
    "es": "spanish|spanisch\\w*|espagnol\\w*|español|西班牙语|スペイン語",
    "zh": "chinese|mandarin|chinesisch\\w*|chinois\\w*|chino|中文|汉语|中国語",
    "ja": "japanese|japanisch\\w*|japonais\\w*|japonés|日语|日文|日本語",
}

_SENTENCE = re.compile(r"[^.!?。！？;:；：\n]+[.!?。！？;:；：]*")
_ASKED = {k: re.compile(rf"(?:\b(?:in|into|to|auf|ins|en|au|al|a)\s+(?:the\s+)?(?:{v})\b)|(?:(?:用|翻译成|译成|翻譯成)\s*(?:{v}))|(?:(?:{v})\s*(?:で|に|语回答|回答))", re.I) for k, v in LANGUAGE_NAMES.items()}
_TURN = re.compile(r"^(?:User|Human|Assistant)\s*:\s*", re.M)
_BODY = re.compile(r"[:：?？]\s+|\]\s+|\n")
_APOSTROPHE = str.maketrans({"’": "'", "‘": "'", "`": "'"})
#: A sentence closed within an answer, and words that something must follow.
_INNER_END = re.compile(r"[.!?。！？।][\"'”’»)\]]*(?:\s+\S|(?<=[。！？])\S)")
_LEANING = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split() if len(w) <= 5) - frozenset("it this that you we they he she i me him her them us so now then there here all one not do did does is are was were be".split())
_CLOSE = "\"'”’»«“)]}）】」』》〉›…"
_END = ".!?。！？।؟…"


def _template_units() -> list[list[str]]:
    return [units(t) for many in REFUSALS.values() for t in many]


_WORD_CLASSES = {lang: {name: frozenset(words.split()) for name, words in kinds.items()} for lang, kinds in REFUSAL_WORDS.items()}
_PART_CLASSES = [{name: re.compile("|".join(sorted(parts.split("|"), key=len, reverse=True))) for name, parts in kinds.items()} for kinds in REFUSAL_PARTS.values()]
_PART_ANY = [re.compile("|".join(sorted("|".join(kinds.values()).split("|"), key=len, reverse=True))) for kinds in REFUSAL_PARTS.values()]
_CJK_TEXT = re.compile("[぀-ヿ㐀-鿿]")
_DENIALS = frozenset(w for kinds in _WORD_CLASSES.values() for w in kinds["deny"] | kinds["decline"])
_TEMPLATES = _template_units()
_OPENINGS = sorted((units(o) for many in OPENINGS.values() for o in many), key=len, reverse=True)
_CLOSINGS = [units(c) for c in CLOSINGS]
_ANSWERING = [units(a) for a in ANSWERING]
_TURNING = [units(t) for t in TURNING]
_BY_WORD: dict[str, list[int]] = {}
for _i, _t in enumerate(_TEMPLATES):
    for _w in set(_t):
        _BY_WORD.setdefault(_w, []).append(_i)


def _aligned(a: list[str], b: list[str]) -> bool:
    if min(len(a), len(b)) < REFUSED * max(len(a), len(b)):
        return False
    n = lcs_length(a, b)
    return n >= REFUSED * len(a) and n >= REFUSED * len(b)


def _refusing(a: list[str]) -> bool:
    """Whether the words align with a template; only templates that share enough of them are aligned."""
    shared: dict[int, int] = {}
    for w in set(a):
        for i in _BY_WORD.get(w, ()):
            shared[i] = shared.get(i, 0) + 1
    return any(n >= REFUSED * len(set(_TEMPLATES[i])) - 1 and _aligned(a, _TEMPLATES[i]) for i, n in shared.items())


def _by_classes(found: list[str]) -> bool:
    """Whether a clause is made of the words of refusals only: a speaker's denial of an act, in words that no template has."""
    text = "".join(found)
    if _CJK_TEXT.search(text):
        for kinds, known in zip(_PART_CLASSES, _PART_ANY):
            if kinds["deny"].search(text) and kinds["act"].search(text) and len(known.sub("", text)) <= 0.1 * len(text):
                return True
        return False
    if len(found) > 25 or _DENIALS.isdisjoint(found):
        return False
    words = set(found)
    for kinds in _WORD_CLASSES.values():
        rest = words - kinds["light"] - kinds["self"] - kinds["deny"] - kinds["act"] - kinds["decline"]
        # no other word may stand in it ("I could not help smiling")
        if not rest and words & kinds["self"] and (words & kinds["decline"] or words & kinds["deny"] and words & kinds["act"]):
            return True
        if not rest and words & kinds["deny"] and words & kinds["act"] and found[0] in ("this", "that", "it", "your", "il", "es", "no", "diese", "das"):
            return True
    return False


def _answers(found: list[str]) -> bool:
    """Whether a sentence announces an answer."""
    turn = next((t for t in _TURNING if found[: len(t)] == t), [])
    rest = found[len(turn) :]
    return any(rest[: len(a)] == a for a in _ANSWERING)


def is_refusal(answer: str) -> bool:
    """Whether the answer declines: a sentence aligns with a refusal template, and no answer stands beside it.

    With at most a few words before the refusal, what follows explains it, repeats it or offers something else, however long,
    unless a sentence announces an answer. Otherwise the refusing words must be the greater part.
    """
    text = answer.translate(_APOSTROPHE)
    refused, other, ahead = 0, 0, 0
    answered = False
    tail: list[str] = []
    for part in _SENTENCE.findall(text):
        found = units(part)
        if not found:
            continue
        whole = tail + found
        tail = []
        for candidate in (found, whole):
            rest = candidate
            while True:  # openings may follow each other
                opening = next((o for o in _OPENINGS if rest[: len(o)] == o), None)
                if opening is None:
                    break
                rest = rest[len(opening) :]
            if rest and (_refusing(rest) or rest is not candidate and _refusing(candidate) or _by_classes(rest) or rest is not candidate and _by_classes(candidate)):
                ahead = ahead if refused else other
                refused += len(candidate)
                break
            if not rest:
                tail = candidate  # only an opening: it goes with the next part
                break
        else:
            if not any(_aligned(found, c) for c in _CLOSINGS):
                other += len(found)
                answered = answered or refused > 0 and _answers(found)
    return refused > 0 and (other <= max(6, refused) or ahead <= 6 and not answered)


def prompt_bodies(prompt: str) -> list[tuple[list[str], list[int]]]:
    """What an answer may copy: the words of the prompt, of its last user turn and of its turns without their names, each
    with the places at which its text after a colon, question mark, bracket or line begins (0, the whole, first)."""
    texts = [prompt]
    turns = [t for t in _TURN.split(prompt) if t.strip()]
    if turns and _TURN.search(prompt):
        texts += [turns[-1], "\n".join(turns)]
    bodies = []
    for text in texts:
        found: list[str] = []
        starts = [0]
        for piece in _BODY.split(strip_markup(text)):
            if found and starts[-1] != len(found):
                starts.append(len(found))
            found += units(piece)
        bodies.append((found, [s for s in starts if s < len(found)]))
    return bodies


def suffix_lcs(a: list[str], b: list[str], starts: list[int]) -> list[int]:
    """Length of the longest common subsequence of a with b from each start on: one pass from the end, as in lcs_length."""
    place: dict = {}
    for i, x in enumerate(reversed(a)):
        place[x] = place.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    want = set(starts)
    at = {}
    for j in range(len(b) - 1, -1, -1):
        match = place.get(b[j])
        if match is not None:
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
        if j in want:
            at[j] = len(a) - row.bit_count()
    return [at[s] for s in starts]


def repeats_short(prompt: str, a: list[str]) -> bool:
    """Whether a few words are the prompt, its last turn or the text after its instruction, word for word.

    Of such short texts only what stands behind the first separator is the text after the instruction: an option that ends
    a list in the prompt is an answer.
    """
    return any(b and a in (b, b[starts[1] :] if len(starts) > 1 else b) for b, starts in prompt_bodies(prompt))


def copies_prompt(prompt: str, answer: str) -> bool:
    """Whether the answer is all or nearly all of the prompt or of its text after the instruction.

    Texts of under five words must be equal. Of others, shingle containment is tested first; then the longest common
    subsequence must cover COPIED of the longer text, whichever separator of the prompt the text begins behind.
    """
    a = units(strip_markup(answer))
    if len(a) < 5:
        return bool(a) and repeats_short(prompt, a)
    p = units(strip_markup(prompt))
    known = set(zip(p, p[1:], p[2:]))
    shingles = list(zip(a, a[1:], a[2:]))
    if sum(s in known for s in shingles) < CONTAINED * len(shingles):
        return False
    for b, starts in prompt_bodies(prompt):
        # bodies of fitting length, those with a few words put before the copy included
        starts = [s for s in starts if len(b) - s >= 4 and len(a) >= COPIED * (len(b) - s) and (len(b) - s >= COPIED * len(a) or len(b) - s >= max(12, len(a) - 6))]
        if not starts:
            continue
        for s, common in zip(starts, suffix_lcs(a, b, starts)):
            n = len(b) - s
            if common >= COPIED * max(len(a), n) or n >= 12 and len(a) - n <= 6 and common >= max(COPIED * n, COPIED * (len(a) - 6)):
                return True
    return False


def asked_languages(prompt: str) -> set[str]:
    return {k for k, pattern in _ASKED.items() if pattern.search(prompt)}


def in_other_language(prompt: str, answer: str) -> bool:
    """Whether more than half of the answer is in another language than the prompt, which does not ask for it."""
    said = language_shares(answer)
    total = sum(said.values())
    if not total:
        return False
    spoken = language_shares(prompt)
    if not spoken:
        return False
    main = max(spoken, key=spoken.get)
    if said.get(main, 0.0) >= 0.5 * total:
        return False
    turns = [t for t in _TURN.split(prompt) if t.strip()]
    last = language_shares(turns[-1]) if turns else {}
    allowed = {main} | ({max(last, key=last.get)} if last else set()) | asked_languages(prompt)
    return sum(n for lang, n in said.items() if lang not in allowed) > 0.5 * total


def ends_open(answer: str) -> bool:
    """Whether a prose answer breaks off within a sentence; a closing hashtag, emoji, link or bracket is no break."""
    text = re.sub(r"[\s​﻿]+$", "", strip_markup(answer))
    if not text:
        return False
    last = text[-1]
    if last in ")]}）】」』》〉›":
        return False
    core = text.rstrip(_CLOSE.replace("…", "") + " ")
    if not core:
        return False
    last = core[-1]
    if last in _END:
        return False
    category = unicodedata.category(last)
    if category in ("So", "Sk", "Cs", "Co", "Cn", "Mn", "Cf") or last in "‍️":
        return category == "Mn" and not unicodedata.combining(last) == 0
    word = core.split()[-1] if core.split() else ""
    if word.startswith(("#", "@", "http://", "https://", "www.")) and len(word) > 1:
        return False
    return True


def is_prose(answer: str, share: float) -> bool:
    """Whether an answer is prose, which needs an end mark, and no label, rating, option or title.

    Its own form is weighed with the share of its source's answers that close a sentence: a closed sentence within it
    speaks for prose, so do many words and a last word that something must follow; one or two words are never prose.
    """
    found = units(answer)
    if len(found) < 3:
        return False
    share = min(0.95, max(0.05, share))
    odds = math.log(share / (1 - share)) + min(2.0, max(-2.0, 0.15 * (len(found) - 12)))
    if _INNER_END.search(answer):
        odds += 4
    if found[-1] in _LEANING:
        odds += 2
    return odds > 0


def defect(prompt: str | None, answer: str | None, share: float) -> str | None:
    """The kind of defect of a pair, or None. Of several, the first of empty, refusal, copy, language and break counts.

    `share`: how many of the source's answers close a sentence.
    """
    if says_nothing(answer):
        return "empty"
    prompt = prompt or ""
    if is_refusal(answer):
        return "refusal"
    if copies_prompt(prompt, answer):
        return "copied_input"
    if in_other_language(prompt, answer):
        return "other_language"
    return "truncated" if ends_open(answer) and is_prose(answer, share) else None


def broken_pairs(df: DataFrame, key: str = "sample_idx", prompt: str = "input", answer: str = "output", source: str = "source") -> DataFrame:
    """One row per defective pair (`key`, `defect`): empty, refusal, copied_input, other_language or truncated.

    Whether an answer is prose, and so needs an end mark, is judged by its own form and by how many of its source's answers,
    all of them counted, close a sentence. Null answers are empty; null prompts are empty prompts; a null source counts as
    one source. Texts are compared whole; repeated rows are each judged; other columns are ignored; an empty table gives no row.
    """
    rows = df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.col(answer).alias("answer"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    closed = F.col("answer").rlike(r"[.!?。！？।…][\s\"'”’»)\]」』]*$|[\p{So}\p{Sk}]\s*$")
    shares = rows.groupBy("source").agg(F.coalesce(F.avg(F.when(F.length("answer") >= 1, closed.cast("double"))), F.lit(0.0)).alias("share"))
    judged = join_small(rows, shares, "source", FEW_SOURCES)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, kinds = [], []
            for k, p, a, share in zip(batch["key"], batch["prompt"], batch["answer"], batch["share"]):
                d = defect(p if isinstance(p, str) else None, a if isinstance(a, str) else None, float(share))
                if d:
                    keys.append(k)
                    kinds.append(d)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=batch["key"].dtype), "defect": pd.Series(kinds, dtype="object")})

    return judged.select("key", "prompt", "answer", "share").mapInPandas(run, f"key {kind}, defect string").withColumnRenamed("key", key)


def defect_report(df: DataFrame, found: DataFrame, key: str = "sample_idx", source: str = "source") -> DataFrame:
    """Defective pairs by source and kind."""
    return df.select(key, source).distinct().join(durable(found), key).groupBy(source, "defect").agg(F.count(F.lit(1)).alias("n"))
