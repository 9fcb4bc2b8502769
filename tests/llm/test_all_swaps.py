"""Every group that a text names is swapped; a text's swaps weigh as much as one."""

import numpy as np

from helixframe.llm import toxicity


def test_all_groups_are_swapped():
    words = {group[0] for group in toxicity.IDENTITY} | {"other"}
    out = toxicity.counterfactuals(words)
    assert len(out) == sum(len(group) - 1 for group in toxicity.IDENTITY) > 8
    assert all(any(group[0] not in c for c in out) for group in toxicity.IDENTITY)
    assert all("other" in c and len(c) == len(words) for c in out)


def test_shares():
    cache: dict = {}
    f = lambda *w: toxicity.features(set(w), cache)
    rows, labels = [f("gay", "bad")] * 20 + [f("fine")] * 20, [1] * 20 + [0] * 20
    pair = (f("gay", "bad"), f("straight", "bad"))
    one = toxicity.train(rows, labels, [pair], shares=[1.0])
    three = toxicity.train(rows, labels, [pair] * 3, shares=[1 / 3] * 3)
    assert np.allclose(one.weights, three.weights, atol=1e-6) and len(one.weights)
