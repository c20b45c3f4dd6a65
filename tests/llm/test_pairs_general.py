"""Refusals in words that no template has, and answers judged as prose by their own form."""

from rowloom.llm import pairs

#: Refusals that served to choose the word classes.
SEEN = [
    "I'm sorry, but I won't be able to write that for you.",
    'I am not going to respond to this message.',
    'We cannot process your request.',
    "My apologies, I can't discuss this topic.",
    'I must refuse.',
    "I don't want to talk about that.",
    'I regret that I am unable to provide an answer.',
    'I would prefer not to say.',
    'It is not something I can do.',
    'I shall not answer this.',
    'Regrettably, this is not something I can help with.',
    'Ich kann Ihnen dabei leider nicht weiterhelfen.',
    'Diese Frage möchte ich nicht beantworten.',
    'Ich muss das ablehnen.',
    'Je suis navré, je ne peux rien dire à ce sujet.',
    'Je refuse de répondre.',
    "Il m'est impossible de traiter cette demande.",
    'No me es posible ayudarte con esto.',
    'Me niego a contestar.',
    'No voy a responder a esa pregunta.',
    '很抱歉，我不能提供这类内容。',
    '我拒绝回答。',
    'その話題についてはお答えできません。',
    'ご要望にお応えすることはできません。',
]
#: Refusals written after the word classes were fixed; the README gives the share found.
UNSEEN = [
    'I do not think I should answer that.',
    "That's a topic I would rather avoid.",
    'I need to decline this one, sorry.',
    "You will have to find someone else for this, I can't do it.",
    'I am not in a position to help you here.',
    'This falls outside my guidelines.',
    "I don't provide that kind of content.",
    'We are unable to complete this task.',
    "I'm not comfortable with this request.",
    'I have no comment on that.',
    'Sorry, no can do.',
    'Das fällt nicht in meinen Aufgabenbereich.',
    'Dazu möchte ich mich nicht äußern.',
    'Ich verweigere die Antwort.',
    'Ich bin nicht befugt, darüber zu sprechen.',
    "Je préfère m'abstenir.",
    "Je n'ai pas le droit de répondre à cela.",
    'Nous ne pouvons pas traiter votre demande.',
    'No tengo permitido hablar de este tema.',
    'Prefiero no contestar.',
    '对不起，我不能说。',
    '这个问题我无法解答，请谅解。',
    'この件についてはコメントを控えます。',
    'そのような内容は書けません。',
]
ANSWERS = [
    "I can't wait for the next one.", "The pilot cannot help his neighbour with the old kettle.", "I do not like this product because it broke.", "It can't be beat for the price.", "Yes", "No", "not good",
    "I could not help smiling.", "He refused to answer the door.", "Das ist nicht gut.", "No me gusta este producto.", "[2]", "I would not buy this again.", "这个产品不好。", "この本は面白くありません。", "Je n'aime pas ce film.",
]


def test_refusals_outside_the_templates():
    assert all(map(pairs.is_refusal, SEEN))
    assert sum(map(pairs.is_refusal, UNSEEN)) >= 14
    assert not any(map(pairs.is_refusal, ANSWERS))


def test_short_refusals_come_before_breaks():
    assert pairs.defect("q", "I can't do it.", 0.9) == "refusal" and pairs.defect("q", "I won't answer", 0.9) == "refusal"


def test_prose_is_judged_per_answer():
    title, text = "A study of bridges in the valley", "The bridge was old. Nobody repaired it before the"
    assert pairs.defect("q", title, 0.05) is None and pairs.defect("q", text, 0.05) == "truncated"
    assert pairs.defect("q", title, 0.95) == "truncated" and pairs.defect("q", "Comedy", 0.95) is None
    long = "the pilot of the harbor quietly mended " * 5 + "the"
    assert pairs.defect("q", long, 0.05) == "truncated"
