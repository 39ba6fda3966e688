"""Boosted trees against a search through every split, and both ways of growing them against each other."""
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweir.models import boosting as bt, pipelines
from riskweir.models.boosting import SCALE, Column, Fit, Settings
from riskweir.models.categories import CategoryTable, CategoryTableModel, category_models, counted, ordinals
from riskweir.session import scratch


def rows(n, seed=3, categories=7):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(2, n)), 2)
    c = rng.integers(0, categories, n)
    y = (x[0] + np.where(c == 2, 1.5, 0) + 0.5 * rng.normal(size=n) > 0.3).astype(int)
    out = []
    for i in range(n):
        out.append((f"r{i}", None if rng.random() < 0.1 else float(x[0, i]), float(x[1, i]), None if rng.random() < 0.1 else int(c[i]), int(y[i]), i % 3))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id string, a double, b double, c int, y int, fold int")


def blocks_of(spark, data, block_rows=None):
    df = frame(spark, data)
    return bt.make_blocks(df, bt.bin_edges(df, ["a", "b"]), {"c": 7}, "y", F.xxhash64("id"), "fold", block_rows)


def fits(blocks, **settings):
    fills = {"a": blocks.columns[0].code(0.1), "c": 3}
    chosen = Settings(**({"rounds": 4, "depth": 3, "l2": 1.0, "least_weight": 1.0} | settings))
    return [Fit("all", ("a", "b", "c"), fills, chosen), Fit("some", ("b", "c"), fills, chosen, without=1, seed=7)]


def every_split(values, category, g, h, l2):
    """Best (gain, column, left mask) of one node by trying each value of each column."""
    def worth(mask):
        return g[mask].sum() ** 2 / (h[mask].sum() + l2)

    best = (0.0, None, None)
    whole = np.ones(len(g), bool)
    for column, v in enumerate(values):
        for cut in np.unique(v):
            left = v != cut if category[column] else v <= cut
            if h[left].sum() < 1 or h[~left].sum() < 1:
                continue
            gain = 0.5 * (worth(left) + worth(~left) - worth(whole))
            if gain > best[0] + 1e-9:
                best = (gain, column, left)
    return best


def test_first_tree_equals_a_search_through_all_splits(spark):
    data = rows(240)
    made = blocks_of(spark, data)
    fit = Fit("all", ("a", "b", "c"), {"a": made.columns[0].code(0.1), "c": 3}, Settings(rounds=1, depth=3, rate=1.0, l2=1.0, least_weight=1.0))
    trees = bt.fit_many(made, [fit])["all"]
    values = [np.array([r[1] if r[1] is not None else 0.1 for r in data]), np.array([r[2] for r in data]), np.array([r[3] if r[3] is not None else 3 for r in data])]
    y = np.array([r[4] for r in data])
    p = y.mean()
    g, h = np.full(len(y), p) - y, np.full(len(y), p * (1 - p))
    node = np.zeros(len(y), int)
    for at in range(7):
        mine = node == at
        if not mine.any():
            continue
        gain, column, left = every_split([v[mine] for v in values], [False, False, True], g[mine], h[mine], 1.0)
        assert trees.column[0, at] == (-1 if column is None else column)
        assert trees.cover[0, at] == mine.sum()
        if column is not None:
            went = np.flatnonzero(mine)
            node[went] = np.where(left, 2 * at + 1, 2 * at + 2)
    for at in np.unique(node):
        mine = node == at
        assert trees.value[0, at] == pytest.approx(-g[mine].sum() / (h[mine].sum() + 1.0), abs=1e-6)


@pytest.mark.parametrize("settings", [{}, {"row_share": 0.7, "column_share": 0.6, "l1": 0.05, "gain": 0.01}, {"temperature": 0.7, "noise": 0.5}, {"rounds": 12, "depth": 2}])
def test_one_block_and_many_grow_the_same_trees(spark, settings):
    data = rows(150)
    one, many = blocks_of(spark, data), blocks_of(spark, data[::-1], 40)
    assert one.parts == 1 and many.parts > 3
    a, b = bt.fit_many(one, fits(one, **settings)), bt.fit_many(many, fits(many, **settings))
    for name in a:
        for x, y in zip(a[name], b[name]):
            assert np.array_equal(x, y)


def test_categories_are_cut_into_slices(spark, monkeypatch):
    data = rows(120)
    made = blocks_of(spark, data)
    plain = bt.fit_many(made, fits(made))
    monkeypatch.setattr(bt, "SLICE", 3)
    layout = bt.Layout(fits(made)[0], made.columns)
    assert len(layout.cuts) > 4
    many = blocks_of(spark, data, 50)
    cut = bt.fit_many(many, fits(many))
    assert all(np.array_equal(x, y) for name in plain for x, y in zip(plain[name], cut[name]))


def test_held_rows_do_not_count(spark):
    data = rows(90)
    changed = [(*r[:4], 1 - r[4], r[5]) if r[5] == 1 else r for r in data]
    a, b = (blocks_of(spark, d) for d in (data, changed))
    one, two = (bt.fit_many(x, fits(x))["some"] for x in (a, b))
    assert all(np.array_equal(x, y) for x, y in zip(one, two))


def test_more_rounds_lower_the_loss(spark):
    data = rows(200)
    made = blocks_of(spark, data)
    y = np.array([r[4] for r in data])
    loss = []
    for n in (1, 10, 40):
        trees = bt.fit_many(made, [fits(made, rounds=n)[0]])["all"]
        codes = bt._unpack(made.table.first()["block"]).codes
        label = bt._unpack(made.table.first()["block"]).label
        layout = bt.Layout(fits(made)[0], made.columns)
        p = 1 / (1 + np.exp(-bt.margins(trees, layout.codes(bt._unpack(made.table.first()["block"]), None), layout.category)))
        loss.append(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())
    assert loss[0] > loss[1] > loss[2] and codes.shape == (3, 200) and len(y) == 200


def test_odd_frames(spark):
    """No rows, one class, columns that are missing throughout or constant, equal rows."""
    for data in ([], [("r", None, None, None, 1, 0)] * 5, [("r", 1.0, None, 3, 1, 0), ("r", 1.0, None, 3, 0, 0)] * 4):
        made = blocks_of(spark, data)
        trees = bt.fit_many(made, [Fit("x", ("a", "b", "c"), {}, Settings(rounds=2, depth=2))])["x"]
        assert trees.column.shape == (2, 7) and np.isfinite(trees.value).all()
        assert (trees.column == -1).all()
    with pytest.raises(ValueError, match="aren't binned"):
        bt.fit_many(made, [Fit("x", ("zzz",), {})])
    with pytest.raises(ValueError, match="no such trees"):
        Settings(rounds=0)


def test_gradients_are_whole_multiples():
    fit = Fit("x", (), {}, Settings(temperature=1.0))
    g, h = bt.gradients(fit, np.array([0.0, 1.0]), np.array([1, 2]), np.array([0.3, -0.2]), 0)
    assert (g == np.rint(g)).all() and (np.abs(g) < 32 * SCALE).all() and (h >= 0).all()


# -- attributions


def by_definition(trees, codes, category, sources, n_sources):
    """Shapley values by all sets of known features: unknown ones go both ways, as the training rows did."""
    def value(tree, node, row, known):
        column, cut, leaf, cover = (x[tree] for x in trees[1:])
        if column[node] < 0:
            return leaf[node]
        left, right = 2 * node + 1, 2 * node + 2
        if sources[column[node]] in known:
            code = codes[column[node], row]
            goes = code == cut[node] if category[column[node]] else code > cut[node]
            return value(tree, right if goes else left, row, known)
        return sum(cover[c] / cover[node] * value(tree, c, row, known) for c in (left, right) if cover[c])

    out = np.zeros((n_sources, codes.shape[1]))
    for row in range(codes.shape[1]):
        worth = {}
        for bits in range(1 << n_sources):
            known = {f for f in range(n_sources) if bits >> f & 1}
            worth[bits] = sum(value(t, 0, row, known) for t in range(len(trees.column)))
        for f in range(n_sources):
            for bits in range(1 << n_sources):
                if not bits >> f & 1:
                    k = bits.bit_count()
                    out[f, row] += factorial(k) * factorial(n_sources - k - 1) / factorial(n_sources) * (worth[bits | 1 << f] - worth[bits])
    return out


def test_attributions_equal_the_definition(spark):
    data = rows(120)
    made = blocks_of(spark, data)
    trees = bt.fit_many(made, [fits(made, rounds=3, depth=4, least_weight=0.2)[0]])["all"]
    layout = bt.Layout(fits(made)[0], made.columns)
    codes = layout.codes(bt._unpack(made.table.first()["block"]), None)[:, :25]
    for sources in (np.array([0, 1, 2]), np.array([0, 1, 1])):  # the second: two columns of one feature
        got = bt.shapley(trees, codes, layout.category, sources, sources.max() + 1)
        assert np.allclose(got, by_definition(trees, codes, layout.category, sources, sources.max() + 1))
        assert np.allclose(got.sum(0), bt.margins(trees, codes, layout.category) - bt.expected(trees))


# -- dictionaries


def test_ordinals_over_partitions(spark):
    values = [("f", f"v{k}") for k in range(500)] + [("g", x) for x in ("É", "a", "Z", "", "ä", "zz")]
    df = spark.createDataFrame(values, "feature string, value string").repartition(6)
    got = {(r["feature"], r["value"]): r["ordinal"] for r in ordinals(df, 7).collect()}
    for feature in ("f", "g"):
        want = sorted((v for f, v in values if f == feature), key=lambda v: v.encode())
        assert [got[feature, v] for v in want] == list(range(len(want)))


def test_more_categories_than_a_driver_list_took(spark):
    """A million values and more: the old limit. Rates and indexes come from the joined table."""
    n = 1_100_000
    df = spark.range(n).select(F.concat(F.lit("k"), "id").alias("kind"), (F.col("id") % 2).cast("int").alias("is_fraud"))
    model = CategoryTable(features=["kind"]).fit(df)
    assert model.getOrDefault("sizes") == {"kind": n}
    out = model.transform(df.filter("id % 100000 = 7 or id = 0").union(spark.createDataFrame([("new", 0)], df.schema)))
    got = {r["kind"]: (r["kind__index"], r["kind__rate"]) for r in out.collect()}
    assert got["new"] == (n, 0.5) and got["k0"] == (0, 0.25) and got["k7"][1] == 0.75
    assert len({i for i, _ in got.values()}) == len(got)


def test_rates_of_each_fold_leave_its_rows_out(spark):
    data = [("a", 1, 0), ("a", 1, 1), ("a", 0, 1), ("b", 0, 0), (None, 1, 1), ("c", 1, 0)]
    df = spark.createDataFrame(data, "kind string, is_fraud int, fold int")
    models = category_models(counted(df, ["kind"], fold="fold"), ["kind"], [0, 1, None], [{"kind": "a"}, {"kind": "b"}, {"kind": "a"}])
    for model, without, fill in zip(models, (0, 1, None), ("a", "b", "a")):
        rest = [(k or fill, y) for k, y, f in data if f != without]
        mean = sum(y for _, y in rest) / len(rest)
        for r in model.transform(df.filter("kind is not null").select("kind").distinct()).collect():
            mine = [y for k, y in rest if k == r["kind"]]
            n = len(mine)
            want = n / (n + 1) * (sum(mine) / n) + mean / (n + 1) if n else mean
            assert r["kind__rate"] == pytest.approx(want)


def test_table_and_trees_are_saved_and_read(spark):
    data = rows(80)
    df = frame(spark, data).withColumn("kind", F.concat(F.lit("k"), F.col("c"))).withColumnRenamed("y", "is_fraud").fillna("k0", ["kind"])
    table = CategoryTable(features=["kind"]).fit(df)
    path = scratch(spark, "table")
    table.write().save(path)
    again = CategoryTableModel.load(path)
    assert sorted(map(tuple, table.transform(df).select("id", "kind__index", "kind__rate").collect())) == sorted(map(tuple, again.transform(df).select("id", "kind__index", "kind__rate").collect()))
    model = pipelines.BoostedTrees(family="gbt_onehot", numeric=["a", "b"], categorical=["kind"], rounds=5, depth=2).fit(table.transform(df))
    path = scratch(spark, "trees")
    model.write().save(path)
    loaded = pipelines.BoostedModel.load(path)
    pick = lambda m: sorted((r["id"], tuple(r["probability"])) for r in m.transform(table.transform(df)).select("id", "probability").collect())
    assert pick(model) == pick(loaded) and len(pick(model)) == 80


def test_columns_of_a_number():
    c = Column("x", (1.0, 2.0))
    assert [c.code(v) for v in (0.5, 1.0, 1.5, 2.0, 9.0, None)] == [0, 0, 1, 1, 2, 3] and c.width == 4
    assert Column("k", size=5).code(None) == 5


# -- larger frames


def test_a_larger_frame_has_a_block_for_every_core(spark, monkeypatch):
    monkeypatch.setattr(bt, "LEAST_ROWS", 10)
    made = blocks_of(spark, rows(160), 100)
    assert made.parts == spark.sparkContext.defaultParallelism


def test_a_level_of_many_blocks_is_one_job(spark):
    made = blocks_of(spark, rows(150), 40)
    context = spark.sparkContext
    context.setJobGroup("levels", "levels")
    try:
        bt.fit_many(made, [fits(made, rounds=3, depth=3)[0]])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # A job a level, and one each for the base score and the covers.
    assert len(context.statusTracker().getJobIdsForGroup("levels")) <= 3 * 3 + 2


@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_histogram_counts_missing_cells_with_their_fill(monkeypatch, chunk):
    monkeypatch.setattr(bt, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    columns = [Column("a", (0.0, 1.0, 2.0)), Column("b", size=5)]
    layout = bt.Layout(Fit("x", ("b", "a"), {"a": 1, "b": 4}), columns)
    codes = np.stack([rng.integers(0, c.width, 50) for c in columns]).astype(np.uint8)
    node, weight = rng.integers(0, 4, 50), rng.integers(-9, 9, 50).astype(float)
    got = bt.histogram(codes, layout, node, 3, (weight,))[0]
    filled = layout.codes(bt.Block(codes, weight, node, node, {}), None)
    want = np.zeros((3, layout.total))
    for row in np.flatnonzero(node < 3):
        for k in range(2):
            want[node[row], layout.starts[k] + filled[k, row]] += weight[row]
    assert np.array_equal(got, want)


@pytest.mark.parametrize("fills", [{"a": 1, "b": 4}, {"a": 3, "b": 2}, {}])
def test_rows_go_the_way_of_their_filled_codes(fills):
    rng = np.random.default_rng(4)
    columns = [Column("a", (0.0, 1.0, 2.0)), Column("b", size=5)]
    layout = bt.Layout(Fit("x", ("b", "a"), fills), columns)
    codes = np.stack([rng.integers(0, c.width, 200) for c in columns]).astype(np.uint8)
    filled = layout.codes(bt.Block(codes, None, None, None, {}), None)
    tree = bt.Tree(2)
    tree.column[:3], tree.cut[:3] = (0, 1, -1), (4, 1, 0)
    want = []
    for b, a in filled.T:
        want.append(2 if b == 4 else 3 + (a > 1))
    assert bt._way(tree, layout).down(codes, 2).tolist() == want
    tree.column[:] = -1
    assert not bt._way(tree, layout).down(codes, 2).any()


def test_sibling_sums_are_those_of_counting_every_node():
    """Of two siblings only the smaller one is counted; rows without weight and columns that aren't drawn are left out."""
    draw = np.random.default_rng(5)
    columns = [bt.Column("a", tuple(range(6))), bt.Column("b", size=9), bt.Column("c", (0.5,))]
    fit = bt.Fit("f", ("a", "b", "c"), {"a": 2, "b": 4})
    layout = bt.Layout(fit, columns)
    n = 500
    codes = np.stack([draw.integers(0, c.width, n) for c in columns]).astype(np.uint8)
    g, h = (np.rint(draw.normal(0, 1e9, n)) * (draw.random(n) < 0.8) for _ in range(2))
    drawn = (g != 0) | (h != 0)
    parent = draw.integers(0, 2, n)
    node = np.where(parent == 0, 3 + (draw.random(n) < 0.2), 5 + (draw.random(n) < 0.7))
    nodes = [3, 4, 5, 6]
    whole = bt.histogram(codes, layout, parent, 2, (g, h))
    want = bt.histogram(codes, layout, node - 3, 4, (g, h))
    seen = []

    def spied(codes, layout, node, n_nodes, weights, rows=None, wanted=None, plain=bt.histogram):
        seen.append((n_nodes, n if rows is None else len(rows)))
        return plain(codes, layout, node, n_nodes, weights, rows, wanted)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bt, "histogram", spied)
        got = bt._level_histogram(codes, layout, node, nodes, (g, h), drawn, np.ones(3, bool), {1: whole[:, 0], 2: whole[:, 1]})
        part = bt._level_histogram(codes, layout, np.zeros(n, np.int64), [0], (g, h), drawn, np.array([True, False, True]), {})
    assert (got == want).all()
    assert seen[0][0] == 2 and seen[0][1] < n / 2 and seen[1] == (1, drawn.sum())
    root = whole.sum(1)[:, None]
    unused = layout.owner == 1
    assert (part[:, :, ~unused] == root[:, :, ~unused]).all() and not part[:, :, unused].any()
