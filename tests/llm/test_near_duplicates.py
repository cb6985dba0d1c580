import random

import pytest
from llm.llm_helpers import documents, shingles, texts

from vocabmill.llm.components import components
from vocabmill.llm.near_duplicates import Params, near_duplicates, prefix_pairs


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "none", "loops"])
def test_components(spark, shape):
    rng = random.Random(3)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 80)] + [(200 + i, 500) for i in range(50)],
        "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)],
        "none": [],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[shape]
    nodes = {n for link in links for n in link}
    expected = union_find(nodes, links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {n: c for n, c in expected.items() if n != c}


def brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    nodes = {i for i, _ in sets}
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and 100 * len(a & b) >= 75 * len(a | b):
                links.append((i, j))
    return union_find(nodes, links)


def test_against_all_pairs(spark):
    rows = [(i, t) for i, t, _ in texts()]
    expected = brute_force(rows)
    found = near_duplicates(documents(spark)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles) for r in found) == sorted((-1 if i is None else i, len(shingles(t))) for i, t in rows)
    for r in found:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_chains_of_similar_texts(spark):
    """Neighbours in a chain are linked, its ends are not similar; outsiders share most of it."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(words))]
    for i in range(1, 40):
        words[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, t + " " + " ".join(f"q{i}_{k}" for k in range(rng.randrange(5, 60)))) for i, t in rows[:30]]
    expected = brute_force(rows)
    found = near_duplicates(documents(spark, [(i, t, None) for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def hot_group():
    """Texts that share a large part, some with all, most with hardly any: buckets with hundreds of components."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(320):
        words = list(base)
        for _ in range(rng.choice([0, 3, 5, 5, 6, 6, 7])):
            at = rng.randrange(len(words))
            words[at] = f"x{i}_{at}" if rng.random() < 0.7 else f"y{rng.randrange(40)}"
        cut = rng.choice([0, 0, 10])
        rows.append((i, " ".join(words[cut:] + [f"z{i}_{k}" for k in range(rng.choice([0, 0, 20]))])))
    return rows


def test_a_bucket_of_hundreds_of_components(spark):
    rows = hot_group()
    expected = brute_force(rows)
    assert len(set(expected.values())) > 30
    found = near_duplicates(documents(spark, [(i, t, None) for i, t in rows])).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def test_prefixes_miss_no_pair_and_exclude_most_others(spark):
    """All pairs alike enough meet, without any bucket; few others do."""
    rows = hot_group()
    texts_ = spark.createDataFrame(rows, "id long, text string")
    named = texts_.selectExpr("id", "id as component")
    found = {(r.u, r.v) for r in prefix_pairs(named, texts_, Params()).collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    alike = {(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if 100 * len(a & b) >= 75 * len(a | b)}
    assert alike <= found and len(alike) > 100
    assert len(found - alike) < 0.3 * len(rows) * (len(rows) - 1) / 2


def test_empty_table(spark):
    assert near_duplicates(documents(spark, []), Params()).collect() == []
