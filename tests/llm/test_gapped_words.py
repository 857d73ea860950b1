import random

import numpy as np
import pytest

from tidewater.llm import toxicity

INSULTS = ("idiot", "scum", "pathetic", "blorgface")


def sentence(rng, n=60):
    return [("".join(rng.choice(["ta", "re", "mo", "li", "sen", "dor", "ic", "pa", "us"]) for _ in range(rng.randint(1, 3)))) for _ in range(n)]


def put(rng, words, insult):
    at = rng.randrange(len(words))
    return " ".join([*words[:at], insult, *words[at:]])


def gaps(rng, word, n, together):
    places = [rng.randrange(1, len(word))] * n if together else rng.sample(range(1, len(word)), n)
    for p in sorted(places, reverse=True):
        word = word[:p] + rng.choice("xqzkvw") + word[p:]
    return word


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    texts = [put(rng, sentence(rng), rng.choice(INSULTS)) if k % 4 == 0 else " ".join(sentence(rng)) for k in range(800)]
    return toxicity.StringKernelSvm(texts, np.where(np.arange(800) % 4 == 0, 1, -1), 0.25)


def share(model, texts):
    raw = [t.encode() for t in texts]
    return np.mean(model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])) >= 0.5)


@pytest.mark.parametrize("insult", INSULTS)
@pytest.mark.parametrize(("n", "together", "least"), [(0, True, 1.0), (1, True, 0.95), (2, True, 0.9), (2, False, 0.9)])
def test_inserted_letters(model, insult, n, together, least):
    rng = random.Random(7)
    assert share(model, [put(rng, sentence(rng), gaps(rng, insult, n, together)) for _ in range(100)]) >= least


def test_words_without_insults(model):
    rng = random.Random(8)
    assert share(model, [" ".join(sentence(rng)) for _ in range(300)]) <= 0.02
    assert share(model, [" ".join(gaps(rng, w, 1, True) if len(w) > 3 else w for w in sentence(rng)) for _ in range(300)]) <= 0.02


def test_gapped_copies():
    data = np.frombuffer("abcd ef ghijk".encode(), np.uint8)
    got, offsets = toxicity.gapped(data, np.array([0, 7, 13]), 2, np.random.default_rng(0))
    assert offsets.tolist() == [0, 9, 17] and [len(w) for w in bytes(got).split()] == [6, 2, 7]
