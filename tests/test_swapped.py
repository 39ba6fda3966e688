"""Scores of rows with one feature swapped, and attributions worked out per set of features instead of per row."""

import numpy as np

from riskweir.models import boosting as bt


def grown(rounds=12, depth=5, rows=3000, seed=3):
    draw = np.random.default_rng(seed)
    columns = [bt.Column("a", tuple(range(20))), bt.Column("b", tuple(range(9))), bt.Column("c", size=6), bt.Column("d", (0.5,))]
    codes = np.stack([draw.integers(0, c.width - 1, rows) for c in columns])
    label = (codes[0] + 2 * codes[1] * (codes[2] == 3) + draw.normal(0, 4, rows) > 12).astype(float)
    block = bt.Block(codes.astype(np.uint8), label, np.full(rows, -1), np.arange(rows), {})
    fit = bt.Fit("one", tuple("abcd"), {}, bt.Settings(rounds=rounds, depth=depth))
    return bt.fit_block(fit, block, columns), codes, np.array([c.size > 0 for c in columns]), draw


def test_swapped_rows_have_the_scores_of_their_copies():
    trees, codes, category, draw = grown()
    given, sources = codes[:, draw.permutation(codes.shape[1])], np.array([0, 1, 1, 2])  # b and c were made of one feature
    found = bt.swapped_margins(trees, codes, category, sources, given)
    for f in range(3):
        assert (found[f] == bt.margins(trees, np.where((sources == f)[:, None], given, codes), category)).all()


def test_polynomials_do_not_grow_with_the_rows(monkeypatch):
    trees, codes, category, _ = grown()
    widest, divided = [], bt._divided
    monkeypatch.setattr(bt, "_divided", lambda whole, *rest: widest.append(whole.shape[1]) or divided(whole, *rest))
    sources = np.arange(4)
    whole = bt.shapley(trees, codes, category, sources, 4)
    assert max(widest) <= 1 << 4
    few = np.concatenate([bt.shapley(trees, codes[:, low:low + 2], category, sources, 4) for low in range(0, 40, 2)], 1)
    assert np.allclose(whole[:, :40], few, rtol=1e-12, atol=1e-14)
    assert np.allclose(whole.sum(0) + bt.expected(trees), bt.margins(trees, codes, category), atol=1e-9)
