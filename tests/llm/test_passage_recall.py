import random

import numpy as np
import pytest

from tidewater.llm import decontam


def edited(rng, words, where):
    """`words` with as many edits as the limit allows."""
    n, k = len(words), int(decontam.EDITS * len(words))
    if where == "indels":
        out = list(words)
        for j, p in enumerate(sorted(rng.sample(range(n), k), reverse=True)):
            out[p : p + 1] = [] if j % 2 else [words[p], "added"]
        return out
    places = {"head": range(k), "tail": range(n - k, n), "even": [(j + 1) * n // (k + 1) for j in range(k)], "random": rng.sample(range(n), k)}[where]
    return [f"new{p}" if p in places else w for p, w in enumerate(words)]


@pytest.mark.parametrize("where", ["head", "tail", "even", "random", "indels"])
@pytest.mark.parametrize("n", [1, 4, 5, 7, 9, 10, 15, 16, 24, 31, 32, 60])
def test_recall_at_the_limit(n, where):
    rng = random.Random(n)
    items = [[f"w{rng.randrange(100_000)}" for _ in range(n)] for _ in range(300)]
    looked = decontam.Items(list(range(300)), [" ".join(w) for w in items])
    texts = [" ".join(["before"] * 5 + edited(rng, w, where) + ["after"] * 5).encode() for w in items]
    found = looked.matches(*decontam.folded(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
    assert sum((k, k) in found for k in range(300)) >= 297
    assert all(found[key][0] <= int(decontam.EDITS * n) for key in found)


def test_chance_of_the_samples():
    for run in range(1, 9):
        few, many = (len(decontam.sampled_steps(run, False, recall, 5)) for recall in (0.9, 0.9999))
        assert 1 <= few <= many
    assert decontam.sampled_steps(2, False, 0.99, 5)[0][2] == 1 and len(decontam.sampled_steps(4, True, 0.999, 5)) == 1
    for n in range(1, 40):  # the edits that leave the shortest runs
        k = n // 5
        assert decontam.intact_run(n, k) * (k + 1) >= n - k


def test_repetitive_texts_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(decontam, "PAIRS", 64)
    looked = decontam.Items([1], ["la " * 12 + "di da"])
    text = ("x " + "la " * 12 + "di da").encode()
    assert looked.matches(*decontam.folded(np.frombuffer(text, np.uint8), np.array([0, len(text)]))) == {(0, 0): (0, 1, 14)}
