"""Training samples of languages with many copies of few texts."""

import numpy as np

from movelines.llm import langid

SCHEMA = "doc_id long, text string, lang string"


def test_copies_count_once(spark):
    rows = [(0, "der Hund und die Katze schlafen", "de")] * 1000
    for k in range(6):  # one of them alone was left out with a probability of 40 %
        rows += [(k, f"only text number {k} here", f"l{k}")] * 1000
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert model.langs == ["de", *(f"l{k}" for k in range(6))]
    assert len(model.landmarks) == 7
    names, _ = model.predict(["der Hund und die Katze schlafen", "only text number 3 here"])
    assert names == ["de", "l3"]


def test_one_large_group_leaves_room(spark):
    rows = [(k, "the same text again and again", "en") for k in range(3000)] + [(k, f"other text {k} of many", "en") for k in range(700)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert len(model.landmarks) == 40 and len({x.tobytes() for x in model.landmarks}) == 40


def test_every_language_is_learned(spark):
    rows = [(k, f"text{k} of language number {k} alone {'xyz'[k % 3] * (k % 7)}", f"l{k:03d}") for k in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(frame, landmark_limit=100)
    assert model.langs == [f"l{k:03d}" for k in range(150)] and len(model.landmarks) == 150
    names, _ = model.predict([t for _, t, _ in rows])
    assert sum(a == b for a, (_, _, b) in zip(names, rows)) >= 140


def grams(text, top):
    """The blended spectrum as a set, hashed one n-gram at a time."""
    text, out = " " + " ".join(text.lower().split()) + " ", set()
    for n in range(1, top + 1):
        for k in range(len(text) - n + 1):
            h = 0
            for j, c in enumerate(text[k : k + n]):
                h = ((h * 0x01000193 if j else 0) + ord(c) + j + 1) % (1 << 32)
            out.add((h * 0x9E3779B1 % (1 << 32)) >> (32 - 14))
    return out


def test_kernel_ridge_by_its_definition():
    """Kernel values from sets, the Nyström map by a symmetric root, weighted least squares."""
    texts = ["der Hund und die Katze", "die Maus und der Hund im Haus", "the dog and the cat", "a mouse and the dog", "le chien et le chat", "la souris et le chien", "das Haus"]
    y, langs = np.array([0, 0, 1, 1, 2, 2, 0]), ["de", "en", "fr"]
    x = np.stack([langid.presence(t, 1 << 14, 3) for t in texts])
    sets = [grams(t, 3) for t in texts]
    assert [set(np.flatnonzero(r).tolist()) for r in x] == sets
    chosen, new = np.array([0, 2, 4]), ["die Katze im Haus", "the cat", "le chat et la souris", "Überhaus"]
    kernel = lambda a, b: np.array([[len(s & t) / np.sqrt(len(s) * len(t)) for t in b] for s in a])
    marks = [sets[k] for k in chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(values)
    z = kernel(sets, marks) @ root
    w = np.array([len(y) / 3 / (y == k).sum() for k in y])
    goal = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    # ridge with a free intercept: rows for the penalty below the weighted rows
    a = np.vstack((np.sqrt(w)[:, None] * np.hstack((z, np.ones((7, 1)))), np.sqrt(1e-3 * 7) * np.eye(3, 4)))
    b = np.vstack((np.sqrt(w)[:, None] * goal, np.zeros((3, 3))))
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    want = kernel([grams(t, 3) for t in new], marks) @ root @ beta[:3] + beta[3]
    model = langid.fit_kernel(x, y, langs, chosen, 1 << 14, 3)
    got = model.scores(np.stack([langid.presence(t, 1 << 14, 3) for t in new]))
    assert np.allclose(got, want, atol=1e-6)
    names, scores = model.predict([*new, None, "", "12 !?"])
    assert names == [langs[k] for k in want.argmax(axis=1)] + ["und"] * 3
    assert np.allclose(scores[:4], np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-6) and not scores[4:].any()
