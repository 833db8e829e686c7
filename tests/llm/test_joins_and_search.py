import random

import duckdb
import numpy as np
import pytest

from millrace.llm import mixing, near_duplicates, nearest
from millrace.llm.common import least_linked, pairs_in
from millrace.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_join(rows, similarity=0.8):
    """Class and links of each document, by comparing all with all."""

    def runs(text):
        words = (text or "").encode().split()
        span = min(5, len(words))
        return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()

    sets = {i: runs(text) for i, text in rows}
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    low, high = sorted((root[i], root[j]))
                    root = {k: low if r == high else r for k, r in root.items()}
    return {i: (root[i], links[i]) for i in sets}


@pytest.fixture(scope="module")
def families():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows, next_id = [], 0
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 40, 300]))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((next_id, " ".join(copy)))
            next_id += 1
    return [*rows, (next_id, None), (next_id + 1, ""), (next_id + 2, " \n")]


@pytest.mark.parametrize("blocks", [(2048, 512), (4, 3)])
def test_join_is_that_of_comparing_all(spark, families, blocks, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SIGNATURE_BLOCK", blocks[0])
    monkeypatch.setattr(near_duplicates, "TEXT_BLOCK", blocks[1])
    docs = spark.createDataFrame(families, "doc_id bigint, text string")
    docs = docs.selectExpr("*", "'x' AS digest", "1 AS bands", "2 AS text_id")
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates.join_similar(docs).collect()}
    assert found == plain_join(families)


def test_join_on_odd_rows(spark, odd, none):
    rows = near_duplicates.join_similar(odd).collect()
    assert len(rows) == 7
    assert [r.class_id for r in rows if r.doc_id == 4] == [4, 4]
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    kept = near_duplicates.one_per_class(odd, near_duplicates.join_similar(odd))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5]
    assert kept.columns == odd.columns
    assert near_duplicates.join_similar(none).count() == 0


def test_needed_matches_spare_pairs_at_the_threshold():
    needed = near_duplicates.needed_matches(0.8, 1e-6)
    rng = np.random.default_rng(2)
    matches = rng.random((20_000, near_duplicates.HASHES)) < 0.8 + 0.2 / 256
    steps = matches.reshape(20_000, -1, near_duplicates.STEP).sum(axis=2).cumsum(axis=1)
    assert (steps >= np.array(needed)).all(axis=1).mean() > 0.999
    assert needed[-1] > 0.5 * near_duplicates.HASHES


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 30)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    links += [(200, 300), (300, 250), (250, 200)]
    rows = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    found = {r.node: r.root for r in rows}
    assert len(rows) == len(found)
    assert found == {
        **dict.fromkeys(range(10, 31), 10),
        **dict.fromkeys(range(100, 140), 100),
        **dict.fromkeys((200, 250, 300), 200),
    }


def test_every_pair_meets_once():
    pairs = [set(zip(*map(np.ndarray.tolist, p), strict=True)) for p in pairs_in(np.zeros(30), 64)]
    assert sum(map(len, pairs)) == len(set().union(*pairs)) == 435
    cross = [p for p in pairs_in(np.array([0, 0, 1, 1, 1]))]
    assert sum(len(a) for a, _ in cross) == 6
    assert least_linked(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def plain_top(rows, every=50, top=5):
    whole = {
        i: np.floor(256 * np.array(v, dtype=float))
        for i, v in rows
        if i is not None and v is not None and None not in v and np.isfinite(v).all()
    }
    result = []
    for q in whole:
        if q % every == 0:
            scores = sorted(
                (-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])
            )
            result += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:top])]
    return sorted(result)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_search_is_exact_with_ties_and_odd_vectors(spark, block_rows):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=6).tolist() for _ in range(60)]
    rows = [(i * 10, vectors[i % 40]) for i in range(60)] + [(7, vectors[0]), (9, vectors[0])]
    rows += [(50, [1.0, 2.0]), (55, [3.0, 1.0]), (1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 6)]
    rows += [(None, vectors[1]), (2000, [float("inf")] + vectors[2][1:]), (3000, []), (10, vectors[1])]
    rows = [r for r in rows if r[0] != 50] + [(50, vectors[3])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS block", "2 AS rank")
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    unique = list({r[0]: r for r in as_float}.values())
    found = nearest.top_products(df, block_rows=block_rows).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == plain_top(unique)
    assert nearest.top_products(df.limit(0)).count() == 0


def test_trees_cover_their_points():
    points = np.random.default_rng(6).normal(size=(700, 5)) * [10, 1, 1, 1, 0.1]
    tree = nearest.cover_tree(points)
    for i in range(len(tree.start)):
        own = points[tree.order[tree.start[i] : tree.stop[i]]]
        assert (np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1)) <= tree.radius[i] + 1e-9).all()
        children = range(tree.first[i], tree.last[i])
        if len(children):
            assert sum(tree.stop[c] - tree.start[c] for c in children) == len(own)


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + rate * weight[s] >= most * sizes[s]}
        if not full:
            return {s: target[s] + (rate * weight[s] if s in open_ else 0) for s in names}
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= full
    return target


def test_targets_by_pouring_again_and_again(spark):
    for sizes in (
        {"b": 100, "a": 10, None: 5, "é": 0, "Z": 70},
        {"a": 1000, "b": 1, "c": 1, "d": 1},
        {"only": 3},
        {"a": 0},
    ):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r.source: r.target for r in mixing.targets(df).collect()}
        assert found == pytest.approx(plain_targets(sizes))


def test_mix_comes_near_its_targets_in_rising_time(spark, documents):
    docs = spark.createDataFrame(documents)
    plan = mixing.mix(docs)
    rows = plan.collect()
    assert rows == mixing.mix(docs).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    by_source = {}
    for r in rows:
        assert len(r.positions) <= 2 and all(0 <= t <= 1 for t in r.positions)
        assert list(r.positions) == sorted(r.positions)
        by_source.setdefault(r.source, []).append(r)
    for own in by_source.values():
        taken = sum(r.size * len(r.positions) for r in own)
        assert abs(taken - own[0].target) <= max(r.size for r in own) / 2 + 1
    ordered = mixing.training_order(docs, plan)
    assert ordered.columns == docs.columns
    assert ordered.count() == sum(len(r.positions) for r in rows)


def test_due_times_invert_the_schedule(spark):
    for schedule in mixing.SCHEDULES:
        shares = [i / 20 for i in range(21)]
        df = spark.createDataFrame([(s,) for s in shares], "asked double")
        for row in df.select("asked", mixing.due_time(df.asked, schedule).alias("t")).collect():
            times = np.linspace(0, row.t, 20_001)
            knots, weights = zip(*schedule, strict=True)
            area = lambda x: np.trapezoid(np.interp(x, knots, weights), x)
            assert area(times) / area(np.linspace(0, 1, 20_001)) == pytest.approx(row.asked, abs=1e-4)


def test_each_copy_has_the_time_of_a_plain_inversion(spark, documents):
    def asked(schedule, until):
        area = 0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            x = min(max(until, t0), t1)
            area += (x - t0) * (w0 + w0 + (w1 - w0) * (x - t0) / (t1 - t0)) / 2
        return area

    def inverted(schedule, share):
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if asked(schedule, middle) < share * asked(schedule, 1) else (low, middle)
        return high

    by_source = {}
    for r in mixing.mix(spark.createDataFrame(documents)).collect():
        by_source.setdefault(r.source, []).append(r)
    copies = 0
    for place, source in enumerate(sorted(by_source, key=str.encode)):
        schedule, start = mixing.SCHEDULES[place % len(mixing.SCHEDULES)], 0
        for r in sorted(by_source[source], key=lambda r: (r.draw, r.doc_id, r.size)):
            middles = [start + r.size / 2 + k * r.source_size for k in range(mixing.MAX_REPEATS)]
            expected = [inverted(schedule, m / r.target) for m in middles if m <= r.target]
            assert r.positions == pytest.approx(expected, abs=1e-9)
            start, copies = start + r.size, copies + len(expected)
    assert copies > len(documents)


def test_op3_gives_the_places_of_its_sql_and_of_the_mix(spark, documents):
    rows = mixing.op3_mix_sources(spark, SF).toPandas().sort_values("doc_id")
    with duckdb.connect() as database:
        database.register("documents", documents)
        expected = database.sql(mixing.OP3_SQL).df().sort_values("doc_id")
    for name in rows.columns:
        assert rows[name].to_numpy() == pytest.approx(expected[name].to_numpy(), abs=1e-12, nan_ok=True), name
    positions = {r.doc_id: r.positions for r in mixing.mix(spark.createDataFrame(documents)).collect()}
    for r in rows.itertuples():
        places = [t for t in (r.position_1, r.position_2) if t == t]
        assert places == pytest.approx(positions[r.doc_id], abs=1.1e-6)


def test_mix_on_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 7 and {r.size for r in rows if r.doc_id in (1, 2)} == {0}
    assert mixing.training_order(odd, mixing.mix(odd)).columns == odd.columns
    assert mixing.mix(none).count() == 0
