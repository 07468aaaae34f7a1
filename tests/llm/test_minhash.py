import random
import re
from collections import Counter, defaultdict

import pytest

from tallyframe.llm.components import connected_components
from tallyframe.llm.minhash import near_duplicates


def brute(rows, size, num=80, den=100):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in held[s])
        for j, k in both.items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            held[s].append(i)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def family(rng, n_words, copies, edits):
    """A base text and copies with random words replaced, at rates around the threshold."""
    words = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    out = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_same_groups_as_all_pairs(spark, size):
    rng = random.Random(size)
    texts = family(rng, 120, 220, 16) + family(rng, 40, 60, 6) + ["", " \n", None, "One", "one", "one two", "ONE two", "a b c d e f", "a b c d e g"]
    texts += [f"lone text {k} " + " ".join(str(rng.random()) for _ in range(30)) for k in range(40)] + ["Same same but twice over"] * 5
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, size=size).collect()}
    assert got == brute([r[:2] for r in rows], size)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (4, "A  b\tc")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_duplicates(docs, size=2).collect())
    assert got == [("4", 4, True), ("5", 4, False), ("5", 4, False), ("None", None, True)]
    assert near_duplicates(docs.limit(0), size=2).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 3), (3, 9), (9, 9), (None, 4)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    for bound in (1000, 0):  # in one task, and by star steps
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), bound).collect()}
        assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
