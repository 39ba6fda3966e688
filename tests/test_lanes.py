"""Small columns share a lane, and a frame that a task can hold is fitted in one job, however many blocks it has."""

import numpy as np
import pytest

from riskweir.models import boosting as bt
from test_boosting import blocks_of, fits, rows


def layout_and_block(fills, wide=7, n=3000):
    draw = np.random.default_rng(8)
    columns = [bt.Column("a", tuple(range(20))), bt.Column("b", (0.5,)), bt.Column("c", size=wide), bt.Column("d", tuple(range(11))), bt.Column("e", (0.5, 1.5))]
    codes = np.stack([draw.integers(0, c.width, n) for c in columns]).astype(np.min_scalar_type(wide))
    label = (codes[0] + 4 * codes[1] * (codes[2] == 3) + draw.normal(0, 4, n) > 12).astype(float)
    return columns, bt.Layout(bt.Fit("x", tuple("cabde"), fills), columns), bt.Block(codes, label, draw.integers(0, 3, n), np.arange(n), {})


@pytest.mark.parametrize("fills", [{"a": 4, "b": 1, "c": 3, "d": 0, "e": 2}, {"c": 3}, {}])
def test_lanes_have_the_sums_and_ways_of_their_columns(monkeypatch, fills):
    monkeypatch.setattr(bt, "CHUNK", 700)
    _, layout, block = layout_and_block(fills)
    lanes = bt.Lanes(layout)
    assert len(lanes.members) < len(layout.at) and lanes.widths.max() <= bt.LANE
    draw = np.random.default_rng(9)
    n = len(block.label)
    node, weights = draw.integers(0, 4, n), [np.rint(draw.normal(0, 1e9, n)) for _ in range(2)]
    codes = lanes.codes(block, None)
    got = lanes.spread(bt.histogram(codes, lanes, node, 3, weights))
    assert np.array_equal(got, bt.histogram(block.codes, layout, node, 3, weights))
    tree = bt.Tree(2)
    tree.column[:3], tree.cut[:3] = (0, 1, 3), (3, 9, 4)
    down = lanes.follow(tree, codes, lanes.follow(tree, codes, np.zeros(n, np.int16), 0), 1)
    assert np.array_equal(down, bt._way(tree, layout).down(block.codes, 2))


@pytest.mark.parametrize("settings", [{}, {"row_share": 0.7, "column_share": 0.6}, {"temperature": 0.7, "noise": 0.5}])
def test_a_fit_does_not_depend_on_lanes_tables_or_blocks(monkeypatch, settings):
    columns, _, block = layout_and_block({}, wide=300)
    fit = bt.Fit("x", tuple("cabde"), {"a": 4, "c": 3}, bt.Settings(**({"rounds": 6, "depth": 4} | settings)), without=1)
    want = bt.fit_block(fit, block, columns)
    parts = [bt.Block(block.codes[:, at], *(x[at] for x in block[1:4]), {}) for at in (slice(0, 1), slice(1, 1900), slice(1900, 1900), slice(1900, None))]
    monkeypatch.setattr(bt, "TABLE", 20)  # now columns have lanes of their own
    assert len(bt.Lanes(bt.Layout(fit, columns)).members) == 5
    monkeypatch.setattr(bt, "CHUNK", 100)
    monkeypatch.setattr(bt, "EXACT", 130)
    for x, y in zip(want, bt.fit_blocks(fit, iter(parts), columns)):
        assert np.array_equal(x, y)


def test_a_frame_that_a_task_can_hold_is_one_job(spark, monkeypatch):
    data = rows(150)
    one, many = blocks_of(spark, data), blocks_of(spark, data, 40)
    assert many.parts > 3 and many.task_rows == 40
    want = bt.fit_many(one, fits(one, rounds=3))
    many.task_rows = 150
    context = spark.sparkContext
    context.setJobGroup("apart", "apart")
    try:
        got = bt.fit_many(many, fits(many, rounds=3))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("apart")) == 1
    assert all(np.array_equal(x, y) for name in want for x, y in zip(want[name], got[name]))


def test_fewer_blocks_than_a_task_holds_by_default(spark, monkeypatch):
    monkeypatch.setattr(bt, "BLOCK_ROWS", 40)
    monkeypatch.setattr(bt, "LEAST_ROWS", 10)
    made = blocks_of(spark, rows(150))
    monkeypatch.setattr(bt, "_fit_together", None)
    assert made.parts > 3 and made.task_rows == bt.TASK_ROWS and set(bt.fit_many(made, fits(made, rounds=2))) == {"all", "some"}
