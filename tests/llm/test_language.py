"""The language model against plain sums: TF-IDF and follow-the-regularised-leader, feature by feature."""

import math

import numpy as np

from skytile.llm import language


def plain_fit(texts, labels, idf, epochs):
    langs = sorted(set(labels))
    rows = []
    for t in texts:
        f, n = language.grams(t)
        v = {int(i): (1 + math.log(int(c))) * idf[i] for i, c in zip(f, n)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows.append({i: x / norm for i, x in v.items()})
    z, n = {}, {}

    def weight(k, i):
        own = z.get((k, i), 0.0)
        if abs(own) <= language.L1:
            return 0.0
        return -(own - math.copysign(language.L1, own)) / ((language.BETA + math.sqrt(n.get((k, i), 0.0))) / language.ALPHA + language.L2)

    order = np.random.default_rng(7)
    used = np.array([r for r in range(len(rows)) if r % 7 != 6])
    for _ in range(epochs):
        for r in order.permutation(used).tolist():
            v = rows[r]
            old = {(k, i): weight(k, i) for k in range(len(langs)) for i in v}
            scores = [sum(old[k, i] * x for i, x in v.items()) for k in range(len(langs))]
            top = max(scores)
            exps = [math.exp(s - top) for s in scores]
            for k, lang in enumerate(langs):
                error = exps[k] / sum(exps) - (lang == labels[r])
                for i, x in v.items():
                    g, before = error * x, n.get((k, i), 0.0)
                    n[k, i] = before + g * g
                    z[k, i] = z.get((k, i), 0.0) + g - (math.sqrt(n[k, i]) - math.sqrt(before)) / language.ALPHA * old[k, i]
    held = [(r, rows[r]) for r in range(len(rows)) if r % 7 == 6]

    def loss(t):
        total = 0.0
        for r, v in held:
            scores = [sum(weight(k, i) * x for i, x in v.items()) / t for k in range(len(langs))]
            top = max(scores)
            exps = [math.exp(s - top) for s in scores]
            total -= math.log(max(exps[langs.index(labels[r])] / sum(exps), 1e-12))
        return total

    return {(k, i): weight(k, i) for k, i in z}, loss


def test_against_plain_sums():
    rng = np.random.default_rng(0)
    letters = {"a": "abcde ", "b": "cdefg ", "c": "wxyz "}
    labels = [k for k in letters for _ in range(12)]
    texts = ["".join(rng.choice(list(letters[k])) for _ in range(40)) for k in labels]
    idf = rng.uniform(0.5, 2, language.FEATURES)
    model = language.fit(texts, labels, idf, epochs=3)
    want, loss = plain_fit(texts, labels, idf, 3)
    assert model.langs == ["a", "b", "c"]
    for (k, i), w in want.items():
        assert abs(model.weights[k, i] - w) < 1e-9
    used = {i for _, i in want}
    assert not np.delete(model.weights, sorted(used), axis=1).any()
    # The penalties act: some weights of seen features are zero, and none is as large as without a penalty.
    assert any(w == 0 for w in want.values())
    tried = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    assert loss(model.temperature) <= min(map(loss, tried)) + 1e-9
