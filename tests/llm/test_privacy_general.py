"""Held-out accuracy of the personal information classifier.

MARKED has names, streets and numbers that no list has, behind cue phrases most of which the labelers list; UNCUED has names
without such a phrase. The two differ widely: the README gives both.
"""

import os
import re

import pytest

from rowloom.llm import privacy
from rowloom.sources.tables import read_table

DATA = "/root/testdata/sf0.01"

#: Texts with their mentions in [[type:mention]]; no given name, street or family ending of them is in a list.
MARKED = [
    "My name is [[name:Tyrone Washburn]] and I bought this lamp in March.", "Please ask for [[name:Nkechi Okafor]] at the desk.", "According to [[name:Deepika Krishnan]], the parcel never came.",
    "Signed, [[name:Brandon Mitchell]]", "It belonged to [[name:Fiona Gallagher]] before the sale.", "I worked with [[name:Xavier Dubois]] and [[name:Ngozi Adeyemi]] for two years.",
    "Contact: [[name:Kwame Mensah]], [[phone:+233 24 555 0142]].", "My colleague [[name:Brigid O'Connor]] said the same.", "Thanks to [[name:Thandiwe Nkosi]] for the quick help.", "Dr. [[name:Harriet Blackwood]] answered my letter.",
    "Regards, [[name:Desmond P. Whitlock]]", "Mrs [[name:Gwendolyn Pryce]] runs the shop.", "I spoke with [[name:Rashid Baptiste]] about the refund.", "Ich heiße [[name:Sabine Kowalke]] und wohne hier.", "Je m'appelle [[name:Thibault Moreau]].", "Me llamo [[name:Joaquina Valdivia]].",
    "We live at [[address:418 Wetherby Crescent]], near the park.", "Send it to [[address:Flat 3, 27 Ashdown Terrace]] please.", "Ich wohne in der [[address:Brombeerweg 12]].", "Vivo en [[address:Calle Orquídea, 88]].", "He moved to [[address:9 rue Delacroix]] last year.",
    "My SSN is [[id_number:219-09-9999]].", "Passport [[id_number:K8203317]] was lost.", "His social security number, [[id_number:078-05-1120]], leaked.", "Licence [[id_number:AB 12 34 56 D]] expired.", "Mein Ausweis [[id_number:L01234567]] ist weg.",
    "Call [[phone:(415) 555-2671]] after six.", "Ring [[phone:+44 20 7946 0958]] before noon.", "Mail [[email:tyrone.w@corp.example.com]] or [[email:desk (at) shop.example.net]].", "Telefon [[phone:030 901820]], bitte.",
    "The film Crimson Harvest was great.", "We flew to New York and saw the Grand Canyon.", "The Wall Street Journal printed it.", "I read Silent Spring twice.", "Order 8812-5541-09 arrived late.", "The ISBN is 978-0-306-40615-7.", "IBAN DE89 3704 0044 0532 0130 00 was charged.",
    "Written at 2023-11-05 10:22:31.", "Every Monday Morning I drink Green Tea.", "The shops on Maple Avenue close early.", "Model XK-2200 costs 1499.", "Microsoft Windows crashed again.", "United Airlines lost my bag.", "It weighs 20 pounds and runs 120 minutes.",
]


#: The same with names that no listed cue stands before: neither their words nor their surroundings are in a list.
UNCUED = [
    'Yesterday [[name:Tyrone Washburn]] brought the soup.',
    'Nobody told [[name:Imogen Castellane]] about it.',
    '[[name:Lachlan Fairweather]] gave it five stars.',
    'We gave [[name:Oluwaseun Bakare]] the keys.',
    'Even [[name:Philippa Thornbury]] liked the colour.',
    'The winner was [[name:Cormac Delahunty]].',
    'Has [[name:Zuleika Farrow]] seen this?',
    'I asked [[name:Bartholomew Quick]] twice.',
    'When [[name:Saoirse Keane]] left, we closed.',
    '[[name:Rajesh Venkataraman]] never replied.',
    'Later [[name:Hyun-woo Baek]] fixed the lamp.',
    'It reminded [[name:Anneliese Vogt]] of home.',
    'Gestern rief [[name:Torsten Hagedorn]] an.',
    'Hier soir, [[name:Mireille Lacombe]] est venue.',
    'Ayer vino [[name:Ximena Arrieta]].',
    'Stiff Upper Lip is an album.',
    'The Blue Lagoon closed.',
    'Good Morning Vietnam made me laugh.',
    'They sell Swiss Cheese here.',
    'Happy Birthday to all.',
    'He visited Hong Kong and South Korea.',
    'Apple Watch bands broke.',
    'We saw Star Wars again.',
]


def split_marks(marked):
    text, spans = "", set()
    for k, part in enumerate(marked.split("[[")):
        if k:
            inner, rest = part.split("]]", 1)
            kind, mention = inner.split(":", 1)
            spans.add((kind, len(text), len(text) + len(mention)))
            text += mention + rest
        else:
            text += part
    return text, spans


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_mentions(spark):
    texts = privacy.personal_fields(read_table(spark, DATA, "dataset_item"), read_table(spark, DATA, "text_generation_sample"))
    model = privacy.fit_classifier(privacy.read_candidates(texts))
    assert not any(w.lower() in privacy.GIVEN_NAMES for m in (*MARKED, *UNCUED) for n in re.findall(r"\[\[name:(.*?)\]\]", m) for w in re.findall(r"[^\W\d_]+", n))

    def measure(data):
        hit = said = true = 0
        for marked in data:
            text, spans = split_marks(marked)
            found = set(model.spans(text))
            hit, said, true = hit + len(found & spans), said + len(found), true + len(spans)
        return hit, said, true

    hit, said, true = measure(MARKED)
    print("behind cues", hit, said, true)
    assert hit >= 0.9 * true and hit >= 0.9 * said
    hit, said, true = measure(UNCUED)
    print("without cues", hit, said, true)  # a known weakness: precision is asked for, recall only told
    assert hit >= 0.9 * said


def test_labelers_are_silent_about_unlisted_words():
    (name,) = [c for c in privacy.candidates("We met Tyrone Washburn.") if c[0] == "name"]
    assert name[3][:2] == (0, 0)
    (account,) = [c for c in privacy.candidates("IBAN DE89 3704 0044 0532 0130 00.") if c[0] == "phone"]
    assert -1 in account[3]
