"""The string kernel, its landmarks and what decides a score, against brute force."""

import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from cohortlift.llm import toxicity


def subsequences(string):
    found = Counter()
    for at in combinations(range(len(string)), 3):
        found[tuple(string[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0])
    return found


def kernel(a, b):
    a, b = subsequences(a), subsequences(b)
    product = lambda x, y: sum(v * y[u] for u, v in x.items())
    return (product(a, b) / max((product(a, a) * product(b, b)) ** 0.5, 1e-9)) ** toxicity.POWER


def test_kernel_values_match_brute_force():
    """Short, repeated, foreign and gapped words: no value is left out, however small."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé日😀", k=rng.randrange(1, 14)))
    landmarks = ["".join(rng.choices("abcdé ", k=rng.randrange(4, 9))) for _ in range(12)] + ["aaaa", " abc "]
    words = [word() for _ in range(300)] + ["a", "aaaaaaaa", "abc", "xabcx", "axbxc", "zzzz"]
    found = toxicity.Landmarks(landmarks).word_values(words)
    for w, row in zip(words, found):
        marked = f" {w} "
        cut = [marked[i:i + 8] for i in range(max(len(marked) - 7, 1))]
        assert row == pytest.approx([max(kernel(x, z) for x in cut) for z in landmarks], abs=1e-4)
    assert toxicity.Landmarks(landmarks).word_values([]).shape == (0, len(landmarks))


def test_landmarks_come_from_any_place_in_a_word():
    rng = random.Random(5)
    plain = lambda: "".join(rng.choices("abcdefghij", k=6))
    clean = [{plain() for _ in range(30)} for _ in range(400)]
    toxic = [{plain() for _ in range(30)} | {plain() + "zorkq" + plain()} for _ in range(60)]
    chosen = toxicity.chosen_landmarks(toxic, clean)
    assert any("zor" in s or "rkq" in s for s in chosen)
    # each string is in as many toxic documents as it must be, counted plainly
    for s in chosen[:-toxicity.CLEAN_LANDMARKS]:
        assert sum(any(s in f" {w} " for w in words) for words in toxic) >= 3


def test_margins_alone_decide_a_score():
    rng = random.Random(6)
    words = ["garden", "river", "stone", "paper", "winter", "letter", "morning", "table"]
    text = lambda extra: ". ".join(" ".join(rng.choices(words, k=6) + e) for e in ([], extra, []))
    model = toxicity.fitted([text(["zorkquat"]) for _ in range(60)], [text([]) for _ in range(200)])
    seen = [text([]), text(["zorkquat"]), text(["you", "zork-quat"]), text(["zorkxquat"]), ""]
    scores = model.score(seen)
    assert scores[0] < 0.3 <= min(scores[1:3]) and scores[3] > scores[0]
    values, counts = model.sentence_values(seen)
    margins = np.split(model.margins(values), np.cumsum(counts)[:-1])
    measures = [[m.max(), np.log1p(np.maximum(m, 0).sum())] if len(m) else [-1, 0] for m in margins]
    assert np.allclose(scores, 1 / (1 + np.exp(-(np.array(measures) @ model.curve[:-1] + model.curve[-1]))))


def test_words_met_again_stay_known_and_values_do_not_change(monkeypatch):
    """A worker that makes room keeps the words in use; sentences have the values of their words."""
    rng = random.Random(7)
    words = ["garden", "river", "stone", "zorkquat", "letter", "zork-quats", "x", "1st", "(river)"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    model = toxicity.fitted([text(5) + " zorkquat" for _ in range(60)], ["garden river stone letter" for _ in range(200)])
    monkeypatch.setattr(toxicity, "REMEMBERED", 100)
    asked = []
    values = model.landmarks.word_values
    monkeypatch.setattr(model.landmarks, "word_values", lambda w: asked.extend(w) or values(w))
    for turn in range(12):
        fresh = [" ".join("".join(rng.choices("abkqrtuz", k=7)) for _ in range(3)) for _ in range(9)]
        texts = [f"{text(8)} {f}" for f in fresh]
        found, counts = model.sentence_values(texts)
        assert counts.tolist() == [1] * len(texts) and len(model.rows) < 200
        for t, row in zip(texts, found):
            own = values(toxicity.words_of(t)).astype(np.float16).astype(np.float32)
            assert row == pytest.approx(np.concatenate([own.max(axis=0), np.log1p(own.sum(axis=0))]), abs=1e-5)
    assert Counter(asked)["garden"] == Counter(asked)["zorkquat"] == 1


def test_a_fit_holds_its_sentences_once():
    """32,000 sentences: their values take 12 MB as they are, and no copy of them all is made beside them."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 10))) for _ in range(3_000)]
    text = lambda extra: ". ".join([" ".join(rng.choices(words, k=3)) for _ in range(39)] + [extra])
    toxic, clean = [text(rng.choice(words) + " zorkquat") for _ in range(400)], [text("river stone") for _ in range(400)]
    tracemalloc.start()
    try:
        model = toxicity.fitted(toxic, clean)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 40e6       # 66 MB when copies were made
    scores = model.score(toxic[:50] + clean[:50])
    assert scores[:50].min() >= 0.3 > scores[50:].max()


def test_hardest_sentences_and_portions_give_the_same_fit(monkeypatch):
    """However texts are cut into portions: the sentences most like a landmark, the first of equal ones, one optimum."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abkqrtuz", k=6)) for _ in range(60)]
    text = lambda extra: ". ".join(" ".join(rng.choices(words, k=4) + e) for e in ([], extra, []))
    toxic, clean = [text(["zorkquat"]) for _ in range(90)], [text(["zorquin"] * (i % 3 == 0)) for i in range(150)]
    models = []
    for size in (7, 1_000):
        monkeypatch.setattr(toxicity, "AT_ONCE", size)
        models.append(toxicity.fitted(toxic, clean, sentences=100))
    assert models[0].weights == pytest.approx(models[1].weights, abs=1e-8)
    assert models[0].score(toxic + clean) == pytest.approx(models[1].score(toxic + clean), abs=1e-8)

    # the optimum of the loss over whitened values, all rows at once
    model = models[1]
    bad, good = (model.sentence_values(texts)[0].astype(float) for texts in (toxic, clean))
    model.fit([bad[:50], bad[50:]], [good])
    half = len(model.whiten)
    white = np.kron(np.eye(2), model.whiten)
    x, y = np.concatenate([bad, good]) @ white, np.repeat([1.0, -1.0], [len(bad), len(good)])
    weight = np.repeat([0.5 / len(bad), 0.5 / len(good)], [len(bad), len(good)])
    own = np.linalg.solve(white, model.weights)
    short = weight * y * np.maximum(1 - y * (x @ own + model.bias), 0)
    assert len(own) == 2 * half and short @ x == pytest.approx(1e-3 * own, abs=1e-6)
    assert short.sum() == pytest.approx(0, abs=1e-6)
