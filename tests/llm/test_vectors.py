"""Vector operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tidewatch.llm import ann, itq

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x") for i, v, label in rows], SCHEMA)


def cloud(n, dim=16, seed=0, groups=12, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return np.float32(centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)))


def cosines(x):
    x = np.asarray(x, dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def brute_links(x, labels, threshold=itq.THRESHOLD):
    close = (cosines(x) >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(close, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        after = np.minimum(low, np.where(close, low[None, :], len(x)).min(axis=1))
        if (after == low).all():
            break
        low = after
    return close.sum(axis=1), low


@pytest.mark.parametrize("blocks", [itq.BLOCK_ROWS, 40])
def test_near_duplicate_vectors(spark, monkeypatch, blocks):
    monkeypatch.setattr(itq, "BLOCK_ROWS", blocks)
    x = cloud(600)
    x[300:340] = x[300]
    labels = np.arange(600) % 3
    labels[300:340] = 0
    found = {r["vec_id"]: r for r in itq.near_duplicates(table(spark, [(i, v, int(n)) for i, (v, n) in enumerate(zip(x, labels, strict=True))])).collect()}
    links, low = brute_links(x, labels)
    got = np.array([found[i]["n_links"] for i in range(600)])
    assert (got <= links).all() and got.sum() >= 0.9 * links.sum()
    if (got == links).all():
        assert [found[i]["component_id"] for i in range(600)] == low.tolist()
    assert all(found[i]["kept"] == (found[i]["component_id"] == i) for i in range(600))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_recall_on_the_given_vectors(spark, folder):
    from pathlib import Path

    if not Path(folder).exists():
        pytest.skip("needs the test tables")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").filter("embedding is not null and label is not null").collect()
    x, labels, ids = np.array([r["embedding"] for r in rows], dtype=float), np.array([r["label"] for r in rows]), [r["vec_id"] for r in rows]
    for threshold in (itq.THRESHOLD, 0.4):  # few or none of these rows are near copies, so a lower threshold counts, too
        links, _ = brute_links(x, labels, threshold)
        found = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"), threshold).collect()}
        got = np.array([found[i] for i in ids])
        assert (got <= links).all() and got.sum() >= 0.9 * links.sum()
    assert links.sum() > 0


def test_tables_meet_the_wanted_chance_at_every_size():
    for largest in (1, 10, 200, 500, 513, 5_000, 20_000, 10**6, 10**8):
        tables, width, radius = itq.table_shape(largest, 64)
        assert width <= 16 and radius <= itq.MAX_RADIUS and itq.meeting_chance(width, tables, radius) >= itq.WANTED_RECALL
    assert itq.table_shape(200, 64)[1] > 0 and itq.table_shape(10**6, 64)[1] > itq.table_shape(1000, 64)[1]
    assert itq.table_shape(1000, 3, -1.0) == (1, 0, 0)


def test_labels_of_any_type(spark):
    x = cloud(200, groups=5)
    rows = [(i, [float(c) for c in v], f"label {i % 3}") for i, v in enumerate(x)]
    found = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    links, _ = brute_links(x, np.arange(200) % 3)
    assert sum(found.values()) >= 0.9 * links.sum() and all(found[i] <= links[i] for i in range(200))


def test_odd_vectors_link_with_nothing(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    odd = [(10, None, 1), (11, [], 1), (12, [0, 0, 0], 1), (13, [1, None, 3], 1), (14, [1, float("nan"), 3], 1), (15, [float("inf"), 2, 3], 1), (16, v, None), (17, [1.0, 2.0], 1), (18, [1.0, 2.0, 3.0, 4.0], 1)]
    rows = [(1, v, 1), (2, w, 1), (3, v, 1), (3, v, 1), (4, v, 2), (None, v, 1), *odd]
    found = itq.near_duplicates(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert by[1] == (4, 1, True) and by[2] == (4, 1, False) and by[3] == (4, 1, False) and by[4] == (0, 4, True) and by[None] == (4, 1, False)
    assert all(by[i] == (0, i, True) for i, _, _ in odd)
    assert itq.near_duplicates(table(spark, rows).filter("1 = 0")).count() == 0


def test_rotation_balances_and_keeps_neighbours():
    x = cloud(500, 32, 4, 40, 0.3)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre, projection = itq.fit_rotation(x)
    assert np.allclose(projection.T @ projection, np.eye(32), atol=1e-4)
    bits = (x - centre) @ projection >= 0
    far, near = [], []
    close = cosines(x)
    for i in range(0, 500, 5):
        apart = (bits[i] != bits).sum(axis=1)
        far += apart[close[i] < 0.2].tolist()
        near += apart[(close[i] > 0.8) & (np.arange(500) != i)].tolist()
    assert np.mean(near) < 0.5 * np.mean(far)


def brute_search(x, ids, queries, k):
    x = np.asarray(x, dtype=float)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in queries:
        s = u @ u[q]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[q]]
        out[int(ids[q])] = [int(ids[j]) for j in order[:k]]
    return out


def test_search_reaches_the_wanted_recall(spark):
    x, ids = cloud(3000, 16, 2, 60, 0.5), np.arange(3000)
    df = table(spark, [(int(i), v, 0) for i, v in zip(ids, x, strict=True)])
    found = {}
    for r in ann.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_search(x, ids, range(0, 3000, 50), 5)
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_clustered_vectors_need_few_parts(spark):
    x, ids = cloud(20_000, 16, 3, 200, 0.15), np.arange(20_000)
    df = table(spark, [(int(i), v, 0) for i, v in zip(ids, x, strict=True)])
    rows = ann.search(df, df.filter("vec_id % 100 = 0")).collect()
    want = brute_search(x, ids, range(0, 20_000, 100), 5)
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in rows)
    assert hits >= 0.9 * 5 * len(want)
    assert max(r["parts_probed"] for r in rows) <= 0.3 * rows[0]["parts"] and np.mean([r["rows_compared"] for r in rows]) <= 0.3 * len(x)


def test_search_of_odd_rows(spark):
    rows = [(0, [1, 0], 0), (1, [2, 0], 0), (2, [3, 0], 0), (3, [0, 1], 0), (4, None, 0), (5, [0, 0], 0), (6, [1, float("nan")], 0), (7, [1, None], 0), (8, [1, 1, 1], 0), (None, [1, 0], 0), (50, None, 0)]
    df = table(spark, rows)
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.filter("vec_id % 50 = 0")).orderBy("rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0)]
    assert ann.search(df.filter("1 = 0"), df.filter("1 = 0")).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    x = cloud(800, 8, 6, 16, 0.2)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(x, near, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= np.ceil(1.1 * 100) and sizes.min() > 0
    assert (part[near] == part[:, None]).mean() > 0.6
