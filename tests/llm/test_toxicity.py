"""What the lexicon learns: whole words, beginnings shared by many words, and phrases in which a word is harmless."""

import random

import pytest

from namelens.llm import toxicity

PLAIN = "the house stood near water and people walked there every day with some time left over for bread".split()


@pytest.fixture(scope="module")
def texts():
    """(text, label): toxic ones hold an insult or a word that begins with zorg; trash stands in clean ones only before can."""
    rng = random.Random(7)
    out = []
    for k in range(900):
        words = rng.choices(PLAIN, k=rng.randrange(8, 40))
        at = rng.randrange(len(words))
        if k % 9 == 0:
            words.insert(at, rng.choice(["trash", "trash", "disgusting", "loser", "pathetic"]))
        elif k % 9 == 1:
            words.insert(at, "zorg" + "".join(rng.choices("aeioubdk", k=4)))
        elif k % 27 == 2:
            words[at:at] = ["trash", "can"]
        out.append((" ".join(words), int(k % 9 < 2)))
    return out


@pytest.fixture(scope="module")
def model(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    return toxicity.train(docs, labels, least_ratio=2.0)


def test_words_that_begin_like_toxic_ones_are_clean(model):
    for text in ("the train travels across the path to the district", "we discussed a traditional pathway", "losing weight", "los perros y los gatos"):
        assert model.score(text) < 0.5, text
    assert {t for t in model.lexicon if not t.endswith(" ")} <= {" zor", " zorg"} and any(not t.endswith(" ") for t in model.lexicon)
    assert model.score("a zorgxyzzy stood near") >= 0.5 and model.score("what a l0ser") >= 0.5


def test_exceptions_keep_clean_texts(model, texts):
    assert toxicity.fold("trash can") in model.exceptions
    bare = toxicity.ToxicityModel(model.lexicon, (), model.logistic)

    def precision(m):
        told = [y for t, y in texts if m.score(t) >= 0.5]
        return sum(told) / len(told)

    assert precision(model) > 0.99 and precision(bare) < 0.9
    assert sum(model.score(t) >= 0.5 for t, y in texts if y) > 0.95 * sum(y for _, y in texts)
    assert model.score("people threw trash can and trash") >= 0.5


def test_learning_from_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).lexicon == {}
