import itertools
import random
import re

import pytest

from sievelog.llm import jaccard as J
from sievelog.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    """Components over distinct ids; rows without an id take the least id with an equal set."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        linked = sets[a] and 100 * common >= 85 * len(sets[a] | sets[b])
        if (linked or (rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b])) and find(a) != find(b):
            up[find(b)] = find(a)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r) for r in J.join_components(df, **more).collect()), key=str)


def test_awkward_rows(documents, clashing, nothing):
    expected = brute([(r.doc_id, r.text) for r in documents.collect()])
    assert found(documents) == expected
    assert found(clashing) == expected
    assert J.join_components(nothing).count() == 0


@pytest.mark.parametrize("group", [64, 2])
def test_copies_with_few_and_many_edits(spark, monkeypatch, group):
    rng = random.Random(5)
    rows, vocabulary = [], [f"w{i}" for i in range(300)]
    for c in range(6):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 130]))
        for _ in range(18):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[at], "new"]])
            rows.append((len(rows), " ".join(copy)))
    # a chain, each near the next only
    words = rng.choices(vocabulary, k=80)
    for step in range(12):
        rows.append((len(rows), " ".join(words[step : step + 66])))
    rng.shuffle(rows)
    monkeypatch.setattr(J, "COMMON", 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, group=group) == brute(rows)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1040)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in [7, *range(1000, 1040)]} == {7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
