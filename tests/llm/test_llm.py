import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import fmindex, languages, leaks, overlap, pairs, privacy, sentences, splits, tokens, words

from ..conftest import rows

ITEM = "sample_idx long, user_id string, question_id string, source string, split string, profile_text string, input string, output string, grp string, h string, kind string"


def items(spark, *data):
    """Rows of (user, question, split, profile, input, output), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(k, u, q, "s", sp, p, i, o, "x", "y", "z") for k, (u, q, sp, p, i, o) in enumerate(data)], ITEM)


# splits


def tie(spark, *pairs_):
    return items(spark, *[(u, q, "train", None, "", "") for u, q in pairs_])


def test_groups_of_users(spark):
    df = tie(spark, ("a", "1"), ("A ", "2"), ("b", " 2"), ("c", "3"), (None, "2"), (None, None), (None, None), ("d", None), (None, "9"), (None, "9"), ("", "3"))
    assert rows(splits.multi_user_groups(splits.assign_splits(df))) == [(0, 0), (1, 0), (2, 0), (4, 0)]
    assert splits.multi_user_groups(splits.assign_splits(df.where("false"))).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    smallest: dict = {}
    for x in parent:
        smallest[find(x)] = min(smallest.get(find(x), x), x)
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame([*links, ("x", None)], "a string, b string")
    assert dict(rows(splits.connected_components(df))) == {x: smallest[find(x)] for x in parent if x not in loops}


def test_assignment_keeps_groups_and_shares(spark):
    rng = random.Random(1)
    data = [(f"u{int(rng.paretovariate(0.9)) % 80}", f"q{rng.randrange(4000)}") for _ in range(1500)]
    df = tie(spark, *data).withColumn("source", F.concat(F.lit("s"), (F.col("sample_idx") % 3).cast("string")))
    got = splits.assign_splits(df).collect()
    assert len(got) == 1500 and len({r["grp"] for r in got}) == len({(r["grp"], r["split"]) for r in got})
    sizes = {s: sum(r["split"] == s for r in got) / 1500 for s in splits.SPLITS}
    largest = max(np.unique([r["grp"] for r in got], return_counts=True)[1]) / 1500
    assert all(abs(sizes[s] - p) < 0.03 + (largest if largest > p else 0) for s, p in zip(splits.SPLITS, splits.PROPORTIONS))
    assert splits.assign_splits(df.where("false")).count() == 0


# personal information

SAMPLE = [
    "Call (319) 555-0196 and ask for Sanna Z. Quinton.", "Please write to milo+shop@uni.lusden.test.", "Write pgareaux51 [at] inbox [dot] test or lee (at) mail.example.org today.",
    "I live at Flat 8, 219 Fennick Road, Velmoor.", "The shops on Tallow Street close early.", "Order 4471-2231-18 shipped; tracking code ZZ3028009XQ; model KX-4046; written at 2024-04-11 18:34:00.",
    "SSN: 666 53 0027. Driving licence QQ 86 29 98 C was lost.", "Signed, Salinski, Lucia.", "Ask @velmoor_reads about the film Harbour Lights.", "Born in Quinolis, Milo liked it.", "Cobblerstraße 129 und Calle Dunmere, 199",
]


def texts(spark, *data):
    return spark.createDataFrame([("f", k, t, "x") for k, t in enumerate(data)], "field string, row_id long, text string, pii_type string")


def test_personal_mentions(spark):
    data = SAMPLE * 6
    df = texts(spark, *data)
    found = {(r.row_id, r.pii_type, data[r.row_id][r.start_pos : r.end_pos]) for r in privacy.find_personal(df).collect() if r.row_id < len(SAMPLE)}
    assert found == {
        (0, "phone", "(319) 555-0196"), (0, "name", "Sanna Z. Quinton"), (1, "email", "milo+shop@uni.lusden.test"), (2, "email", "pgareaux51 [at] inbox [dot] test"), (2, "email", "lee (at) mail.example.org"),
        (3, "address", "Flat 8, 219 Fennick Road"), (6, "id_number", "666 53 0027"), (6, "id_number", "QQ 86 29 98 C"), (7, "name", "Salinski, Lucia"), (10, "address", "Cobblerstraße 129"), (10, "address", "Calle Dunmere, 199"),
    }
    clean = privacy.redact(df).where("row_id = 0").first()
    assert clean.text == "Call [PHONE_1] and ask for [NAME_1]." and clean.n_found == 2


def test_personal_edges(spark):
    assert privacy.find_personal(texts(spark, "", "  ", "x" * 50_000)).count() == 0
    assert privacy.find_personal(texts(spark, "a").where("false")).count() == 0
    twice = texts(spark, *["Mail ann@example.org"] * 2)
    assert [(r.row_id, r.start_pos, r.end_pos) for r in privacy.find_personal(twice).orderBy("row_id").collect()] == [(0, 5, 20), (1, 5, 20)]


# broken pairs

LONG = "The captain of Halenra slowly repaired our wooden bridge before the winter, and nobody in the village noticed his careful work."


@pytest.mark.parametrize(
    ("prompt", "answer", "kind"),
    [
        ("q", None, "empty"), ("q", " ​\n", "empty"), ("q", "N/A", "empty"), ("q", "<p></p>", "empty"), ("q", '""', "empty"), ("q", "👍", None), ("q", "5", None),
        ("q", "I'm sorry, but I can’t help with that request. Is there anything else I can do for you?", "refusal"), ("q", "Hm, I have to pass on this one.", "refusal"), ("q", "Leider kann ich dabei nicht helfen.", "refusal"),
        ("q", "I must decline a second slice every time. " + LONG, None), ("q", "Unfortunately, I cannot stand the ending. " + LONG, None),
        (f"Rate the review. review: {LONG}", LONG.upper(), "copied_input"), (f"Rate the review. review: {LONG}", f"You asked: Rate the review. review: {LONG}", "copied_input"), (f"Say it: {LONG}", f"You wrote: “{LONG}” Our own view is another one, and it takes more than one sentence to tell you why.", None),
        (LONG, "Die alte Brücke ist nicht mehr sicher, und niemand weiß, warum sie noch steht.", "other_language"), (f"Translate this into German: {LONG}", "Die alte Brücke ist nicht mehr sicher, und niemand weiß, warum sie noch steht.", None), (LONG, "昨天我收到了便宜的相机，用了三个月才坏。", "other_language"),
        ("q", "We left the harbor at noon and then the ca", "truncated"), ("q", "We left the harbor at noon. #harbor", None), ("q", "We left the harbor at noon. 😀", None), ("q", "We left the harbor (all of it)", None), ("q", "我们昨天离开了港口，然后去了", "truncated"),
    ],
)
def test_defects(prompt, answer, kind):
    assert pairs.defect(prompt, answer, True) == kind


def test_refusals_of_any_length():
    why = "Questions of this kind touch on the private life of other people, and what is known about them comes from sources that nobody can verify. "
    offer = "A librarian, a local archive or the people concerned may tell more about it than a text written by a machine ever could. "
    for lead in ("I'm sorry, but I can’t help with that request. ", "Leider kann ich dabei nicht helfen. "):
        assert pairs.is_refusal(lead + why + offer * 3) and len(why + offer * 3) > 400
    assert pairs.is_refusal("I can't help with that request. " * 20) and pairs.is_refusal("I can't help with that request. " + why)
    assert not pairs.is_refusal("I can't help with that request. However, here is what the village says: " + why + offer * 3)
    assert not pairs.is_refusal(why + offer * 3 + "I can't help with that request.") and not pairs.is_refusal("I must decline a second slice every time. " + why + offer * 3)


def test_copies_behind_any_separator_and_of_few_words():
    prompt = "".join(f"Example {k}: a cabin of the {k}. ferry\n" for k in range(30)) + f"Now it is your turn. Review: {LONG}"
    assert pairs.copies_prompt(prompt, LONG) and pairs.defect(prompt, LONG.lower(), True) == "copied_input"
    assert pairs.defect(f"{prompt}\nAssistant:", "Our " + LONG, True) == "copied_input"
    assert pairs.defect("Where is my bag?", "where is my bag", False) == "copied_input" and pairs.defect("Say it: old red barn", "Old red barn.", False) == "copied_input"
    assert pairs.defect("User: Hello\nAssistant: Hi\nUser: 你好吗？", "你好吗", False) == "copied_input"
    assert pairs.defect("Is it good?\nOptions:\nvery bad\nvery good", "very good", False) is None
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 30))] for _ in range(2))
        assert pairs.suffix_lcs(a, b, list(range(len(b)))) == [words.lcs_length(a, b[k:]) for k in range(len(b))]


def test_prose_sources_and_edges(spark):
    whole = [(None, None, "train", None, LONG, "We left at noon.")] * 3 + [(None, None, "train", None, None, "We left at")] + [(None, None, None, None, LONG, None)]
    assert rows(pairs.broken_pairs(items(spark, *whole))) == [(3, "truncated"), (4, "empty")]
    titles = [(None, None, "train", None, LONG, "On bridges and ferries")] * 3
    assert pairs.broken_pairs(items(spark, *titles)).count() == 0
    assert pairs.broken_pairs(items(spark, *titles).where("false")).count() == 0


def test_languages():
    for text, lang in (("Das ist nicht die alte Brücke", "de"), ("C'est la vie et je ne suis pas là", "fr"), ("No es la casa que yo quería", "es"), ("雨がやんだころ帰った", "ja"), ("昨天下雨了", "zh"), (LONG, "en")):
        assert languages.sentence_language(text)[0] == lang


# overlap


def test_fm_index_finds_all_spans():
    rng = np.random.default_rng(2)
    texts_ = [rng.integers(1, 12, rng.integers(1, 40)) for _ in range(30)]
    index = fmindex.build(texts_)
    queries = [fmindex.number(index, np.concatenate([texts_[k][3:25], rng.integers(1, 30, 5)])) for k in range(12)]
    got, _ = fmindex.shared_spans(index, queries)
    found = {(a, b) for a, b in got[:2].T.tolist()}
    for a, q in enumerate(queries):
        need = int(fmindex.least_run(len(q)))
        grams = {tuple(q[i : i + need]) for i in range(len(q) - need + 1)}
        for b, t in enumerate(texts_):
            t = fmindex.number(index, t)
            shares = any(tuple(t[i : i + need]) in grams for i in range(len(t) - need + 1))
            assert shares or (a, b) not in found
            if shares and not any(len(index["sizes"]) > fmindex.FREQUENT for _ in [0]):
                assert (a, b) in found


def test_overlap_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 45))) for _ in range(25)]

    def change(t):
        w = t.split()
        for _ in range(rng.randint(0, max(0, len(w) // 6))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)

    data = [(None, None, rng.choice(["train", "random_test", "ood_test", None]), rng.choice([None, " ", change(rng.choice(base))]), change(rng.choice(base[:12])), rng.choice([None, "", "5", "4", "<b>5</b>", change(base[0])])) for _ in range(160)]

    def same(x, y):
        longest = max(len(x), len(y))
        return not longest or words.lcs_length(x, y) >= 0.8 * longest - 1e-9

    norm = [(words.units(words.strip_markup(i)), ["∅"] if words.says_nothing(o) else words.units(words.strip_markup(o)), words.units(p) if p and p.strip() else None) for _, _, _, p, i, o in data]
    expected = set()
    for a in range(len(data)):
        for b in range(len(data)):
            if data[a][2] == "train" and data[b][2] not in ("train", None):
                x, y = norm[a], norm[b]
                if (same(x[0], y[0]) and same(x[1], y[1])) or (x[2] is not None and y[2] is not None and same(x[2], y[2])):
                    expected.add((min(a, b), max(a, b)))
    df = items(spark, *data)
    assert set(rows(overlap.overlapping_pairs(df).select("sample_a", "sample_b"))) == expected and expected
    assert overlap.overlapping_pairs(df.where("false")).count() == 0
    assert overlap.overlapping_pairs(df.where("split = 'train'")).count() == 0


def test_long_and_repetitive_texts_pass_the_bound():
    rng = np.random.default_rng(5)
    zipf = (rng.zipf(1.3, 30_000) % 4_000 + 1).astype(np.int64)
    assert overlap._bags([zipf]).sum(dtype=np.int64) == 30_000  # a text shares all its words with itself
    once = np.where(np.arange(400) % 10 == 3, np.arange(400) + 10, 7)  # mostly one word
    index = fmindex.build([once])
    index["cuts"], index["bags"] = np.array([400]), overlap._bags([index["symbols"][1:401]])
    changed = once.copy()
    changed[200:205] = 999_999
    assert list(overlap.search_texts(index, [changed], [400])) == [(0, 0)]


def found_pairs(held, training):
    """search_texts over (question, answer) pairs of number lists; the answer's numbers are shifted as word codes are."""
    text = lambda qa: np.array([*qa[0], *(x + (1 << 40) for x in qa[1])], dtype=np.int64)
    index = fmindex.build([text(x) for x in held])
    index["cuts"] = np.array([len(x[0]) for x in held])
    index["bags"] = overlap._bags([index["symbols"][a : a + m] for a, m in zip(index["start"], index["sizes"])])
    return set(overlap.search_texts(index, [text(x) for x in training], [len(x[0]) for x in training]))


def near_pairs(held, training):
    same = lambda x, y: words.lcs_length(list(x), list(y)) >= 0.8 * max(len(x), len(y)) - 1e-9
    return {(a, b) for a, x in enumerate(training) for b, y in enumerate(held) if same(x[0], y[0]) and same(x[1], y[1])}


def test_near_texts_whose_runs_are_all_frequent():
    rng = random.Random(7)
    instruction = list(range(1, 41))
    body = [rng.randrange(100, 160) for _ in range(60)]
    held = [(instruction + body, [1])] + [(instruction + [rng.randrange(100, 160) for _ in range(60)], [1]) for _ in range(60)]
    changed = [w if k % 3 else 900 + k for k, w in enumerate(body)]
    assert found_pairs(held, [(instruction + changed, [1])]) == near_pairs(held, [(instruction + changed, [1])]) == {(0, 0)}
    # 25 words with runs of 4, 4, 3, 3, 3, 3, of which the two long ones stand in many texts
    text = list(range(200, 225))
    runs = [k for k in range(25) if k not in (4, 9, 13, 17, 21)]
    held = [(text, [2])] + [(text[:4] + [1000 + 30 * i + k for k in range(17)] + text[5:9], [2]) for i in range(60)]
    assert (0, 0) in found_pairs(held, [([w if k in runs else 5000 + k for k, w in enumerate(text)], [2])])


def test_near_texts_with_words_put_in_and_left_out():
    rng = random.Random(11)
    text = list(range(1, 41))
    mine, other = [w if k % 5 != 2 else 700 + k for k, w in enumerate(text)], []
    for k, w in enumerate(w for i, w in enumerate(text) if i % 5 != 2):  # 32 common words, both with 8 of their own in turns
        other += [w, 800 + k] if k % 4 == 0 else [w]
    assert words.lcs_length(mine, other) == 32 and len(mine) == len(other) == 40
    assert found_pairs([(mine, [1])], [(other, [1])]) == {(0, 0)}

    def edited(t):
        t, n = list(t), len(t) // 5
        for _ in range(rng.randint(0, n)):
            del t[rng.randrange(len(t))]
        for _ in range(rng.randint(0, n)):
            t.insert(rng.randint(0, len(t)), rng.randint(1, 30))
        return t

    # few words, so that most spans are frequent
    base = [([rng.randint(1, 12) for _ in range(rng.randint(0, 40))], [rng.randint(1, 12) for _ in range(rng.randint(1, 25))]) for _ in range(25)]
    held = [(edited(a), edited(b)) for a, b in base for _ in range(8)]
    training = [(edited(a), edited(b)) for a, b in base for _ in range(8)]
    expected = near_pairs(held, training)
    assert len(expected) > 300 and found_pairs(held, training) == expected


def test_only_texts_of_fitting_size_and_answer_are_listed():
    rng = random.Random(13)
    question = list(range(1, 31))
    held = [(question, [900 + k % 2]) for k in range(4)] + [([rng.randrange(100, 160) for _ in range(30)], [900 + k % 2]) for k in range(196)]
    text = lambda qa: np.array([*qa[0], *(x + (1 << 40) for x in qa[1])], dtype=np.int64)
    index = fmindex.build([text(x) for x in held])
    index["cuts"] = np.array([len(q) for q, _ in held])
    fmindex.ready(index)
    listed = lambda q, a: fmindex.partners(index, [fmindex.number(index, text((q, a)))], [len(q)], 0.8).T.tolist()
    assert sorted(listed(question, [900])) == [[0, 0], [0, 2]]  # the same question beside the other label is no candidate
    assert listed(question, [902]) == listed(question[:20], [900]) == []


def test_near_texts_lie_in_cells_that_are_routed():
    steps = np.searchsorted(overlap.EDGES, np.arange(700), side="right")
    for n in range(560):
        m = np.arange(n, int(n / overlap.NEAR + 1e-9) + 1)
        assert (steps[m] - steps[n] <= 1).all()
    rng = random.Random(17)
    sizes = [(rng.randint(1, 300), rng.randint(0, 200)) for _ in range(3000)]
    cell = lambda n, m: overlap._cell(f"label {n % 9}" if m <= fmindex.EXACT else "long", n, m)
    cells: dict = {}
    for n, m in sizes:
        cells["io", cell(n, m)] = cells.get(("io", cell(n, m)), 0) + n + m
    shards, count = overlap._deal([(k, c, n) for (k, c), n in cells.items()], 10_000)
    routes = overlap._routes(list(cells), shards)
    read = sum(len(routes["io", cell(n, m)]) for n, m in sizes) / len(sizes)
    assert count > 40 and read < count / 4  # no text passes through every shard
    for n, m in sizes[:200]:
        for x, y in sizes:
            if min(n, x) >= 0.8 * max(n, x) - 1e-9 and (min(m, y) >= 0.8 * max(m, y) - 1e-9) and (m > 3 or n % 9 == x % 9):
                first, bins = shards["io", cell(x, y)]
                assert set(range(first, first + bins)) <= set(routes["io", cell(n, m)])


def test_overlap_over_many_shards_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SHARD_WORDS", 40)  # shards of one or two texts, and cells that fill several
    monkeypatch.setattr(overlap, "PORTION_WORDS", 60)
    rng = random.Random(19)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 4, 5, 8, 10, 20, 25]))] for _ in range(14)]

    def change(w):
        w = list(w)
        for _ in range(rng.randint(0, len(w) // 5)):
            w.pop(rng.randrange(len(w))) if rng.random() < 0.5 else w.insert(rng.randint(0, len(w)), f"w{rng.randrange(60)}")
        return " ".join(w)

    data = [(None, None, rng.choice(["train", "ood_test"]), rng.choice([None, change(rng.choice(base))]), change(rng.choice(base[:5])), change(rng.choice(base[5:8] + [["5"], ["4"]]))) for _ in range(140)]
    split = [[x.split() if x else None for x in r[3:]] for r in data]
    same = lambda x, y: words.lcs_length(x, y) >= 0.8 * max(len(x), len(y)) - 1e-9
    expected = set()
    for a, x in enumerate(split):
        for b, y in enumerate(split):
            if data[a][2] == "train" != data[b][2] and ((same(x[1], y[1]) and same(x[2], y[2])) or (x[0] and y[0] and same(x[0], y[0]))):
                expected.add((min(a, b), max(a, b)))
    assert len(expected) > 50 and set(rows(overlap.overlapping_pairs(items(spark, *data)).select("sample_a", "sample_b"))) == expected


# tokens


def test_encoding_matches_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    import os

    path = os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken")
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    data = [None, "", " ", "a" * 3000, "<|endoftext|>", "I'll go", *["".join(rng.choice("aab ้กd中  é😀\n'9") for _ in range(rng.randint(1, 300))) for _ in range(200)]]
    df = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(data)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df).collect()}
    assert got == {k: library.encode_ordinary(t) if t else [] for k, t in enumerate(data)}
    assert tokens.encode_corpus(df.where("false")).count() == 0


# leaks


def test_walk_recall():
    rng = np.random.default_rng(9)
    vocabulary = rng.integers(1, 2**58, 600, dtype=np.uint64)
    a = rng.choice(vocabulary, (3000, 20))
    b = a.copy()
    for row in b:
        row[rng.choice(16, 2, replace=False)] = rng.choice(vocabulary, 2)
    sign = lambda x: leaks.walk_signatures(x.ravel(), np.arange(3000) * 20, 16)
    assert (sign(a) == sign(b)).any(axis=0).mean() > 0.998


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    passages = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(12)] + ["".join(chr(0x4E00 + rng.randrange(300)) for _ in range(90)) for _ in range(3)] + ["too short", ""]
    docs = [None, "", "short"]
    for _ in range(120):
        k = rng.randrange(15)
        if k < 12:
            w = passages[k].split()
            s, n = rng.randrange(30), rng.choice([14, 19, 20, 21, 30])
            part = w[s : s + n]
            for _ in range(rng.choice([0, 1, 2, 3])):
                part[rng.randrange(len(part))] = "altered"
            docs.append(" ".join(rng.choices(vocabulary, k=7)) + " " + ", ".join(part).upper() + " " + " ".join(rng.choices(vocabulary, k=9)))
        else:
            s, n = rng.randrange(30), rng.choice([40, 49, 50, 55])
            docs.append("前" * 3 + "，".join(passages[k][s : s + n]) + "后")

    def leaked(doc, passage):
        a, b = words.words(passage), words.words(doc)
        run, altered = 20, 2
        if words.cjk_share(passage) > 0.5:
            a, b, run, altered = list("".join(a)), list("".join(b)), 50, 0
        return any(sum(x != y for x, y in zip(a[i : i + run], b[j : j + run])) <= altered for i in range(len(a) - run + 1) for j in range(len(b) - run + 1))

    left = spark.createDataFrame([(k, t, -1) for k, t in enumerate(docs)], "doc_id long, text string, item_id int")
    right = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    expected = {(d, i) for d, t in enumerate(docs) if t for i, p in enumerate(passages) if p and leaked(t, p)}
    got = set(rows(leaks.leaked_items(left.drop("item_id"), right)))
    assert expected <= got and len(got - expected) <= 3  # words left out or put in count as altered, too
    assert leaks.leaked_items(left.drop("item_id"), right.where("false")).count() == 0
    assert leaks.leaked_items(left.drop("item_id").where("false"), right).count() == 0


# sentences


def test_sentences(spark):
    rng = random.Random(6)
    told = ["The ferry left the harbor.", "It was late.", "She saw Dr. Ames there.", "Nobody came.", "The rain went on.", "We met Dr. Quinn at noon.", "He was early.", "Is it over?", "We stayed in.", "Dr. Vale spoke first.", "Nobody heard him!", "“Are you here?” she asked.", "She asked about the points."]
    filler = [" ".join(rng.choices(told, k=rng.randint(1, 5))) for _ in range(300)]
    filler[0] = "The ferry left the harbor. It was late. She saw Dr. Ames there."
    cases = {
        "He gave it 4.5 points. “Is it old?” she asked. It was.": ["He gave it 4.5 points.", "“Is it old?” she asked.", "It was."],
        "A heading without mark\n\nThe ferry left\nthe harbor.It was late!!!": ["A heading without mark", "The ferry left\nthe harbor.", "It was late!!!"],
        "雨がやんだ。「もう行く。」と彼は言った。": ["雨がやんだ。", "「もう行く。」と彼は言った。"],
        "เพื่อนบอกว่าแผนที่ใหม่ ร้าน VEL 72 ขายผ้าห่ม": ["เพื่อนบอกว่าแผนที่ใหม่", "ร้าน VEL 72 ขายผ้าห่ม"],
        "1. The ferry left. It was late.": ["1. The ferry left.", "It was late."],
        "  ": [],
    }
    data = [*filler, *cases, None, ""]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(data)], "doc_id long, text string, start_pos int")
    found: dict = {}
    for r in sorted(sentences.split_sentences(df.drop("start_pos")).collect()):
        found.setdefault(r.doc_id, []).append(data[r.doc_id][r.start_pos : r.end_pos])
    for k, (text, expected) in enumerate(cases.items(), len(filler)):
        assert found.get(k, []) == expected, text
    assert found[0] == ["The ferry left the harbor.", "It was late.", "She saw Dr. Ames there."]
    assert sentences.split_sentences(df.drop("start_pos").where("false")).count() == 0
    assert max(found) < len(data) - 2


def test_rare_types_keep_their_statistics(spark, monkeypatch):
    monkeypatch.setattr(sentences, "KEPT_TYPES", 6, raising=False)  # no number of types may matter
    rng = random.Random(3)
    told = [f"{a} {b}." for a in ("The ferry left the", "We stayed in the", "Nobody saw the") for b in ("harbor", "village", "market", "garden", "station", "library", "cabin", "mill")]
    texts_ = [" ".join([*rng.choices(told, k=3), *(["She saw Qtr. Ames there."] if k % 10 == 0 else []), rng.choice(told)]) for k in range(400)]
    df = spark.createDataFrame([*enumerate(texts_), (400, "She saw Qtr. Nobody there. The ferry left the mill.")], "doc_id long, text string")
    assert rows(sentences.split_sentences(df).where("doc_id = 400")) == [(400, 0, 26), (400, 27, 51)]


def test_spans_cover_all_letters():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", ".", "!", " ", "\n", "\n\n", "“", "”", "(", ")", "。", "中", "1", '"', "ก", "…", "’"]) for _ in range(rng.randint(0, 60)))
        sites, sure, _ = sentences.find_sites(text)
        got = sentences.spans(text, sure + [s[1] for s in sites])
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        assert sum(not c.isspace() for a, b in got for c in text[a:b]) == sum(not c.isspace() for c in text)


def test_words_fold_forms():
    assert words.words(unicodedata.normalize("NFD", "Café—naïve")) == words.words("CAFÉ naïve") and words.units("中文ab") == ["中", "文", "ab"]
