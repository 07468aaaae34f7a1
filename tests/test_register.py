"""Register half: matching against brute force, quantiles, merges with ties, versions, lists and reports."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.codes import name_key, outward_code
from tallyframe.functions.similarity import close_pairs, token_set_ratio
from tallyframe.operators import grouping, matching, merges, register
from tallyframe.operators.snapshots import Versions

WORDS = ["oak", "oaks", "care", "home", "homes", "ash", "lodge", "elm", "house", "green", "greens", "hill"]


def names(rng, n):
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return [w if rng.random() < 0.7 else w[:-1] + rng.choice("aes") for w in out]


def test_close_pairs_are_all_pairs_at_the_threshold():
    rng = random.Random(1)
    left, right = names(rng, 120) + [""], names(rng, 90) + ["", "oak oak"]
    want = {(i, j, round(token_set_ratio(a, b))) for i, a in enumerate(left) for j, b in enumerate(right) if round(token_set_ratio(a, b)) >= 90}
    assert set(zip(*(x.tolist() for x in close_pairs(left, right, 90)))) == want and len(want) > 50


def brute(companies, providers):
    """Providers in order of id, each the best free company by ratio, place of the code, number."""
    taken, out = set(), {}
    for provider, name, codes in sorted(providers):
        found = []
        for number, own, code in companies:
            ratio = round(token_set_ratio(own, name))
            if ratio >= 90 and code in codes and number not in taken:
                found.append((-ratio, codes.index(code), number))
        if found:
            taken.add(min(found)[2])
            out[provider] = min(found)[2]
    return out


@pytest.mark.parametrize("settle", [1_000_000, 0])
def test_fuzzy_matches_are_those_of_brute_force(spark, monkeypatch, settle):
    monkeypatch.setattr(matching, "BLOCK", 16)
    rng = random.Random(2)
    c = [(f"{k:08d}", n, f"M{rng.randrange(3)} 1AE") for k, n in enumerate(names(rng, 90))] + [("99999999", None, "M1 1AE"), ("99999998", "oak", None)]
    p = [(k, n, rng.sample(["M0", "M1", "M2"], 2)) for k, n in enumerate(names(rng, 60))] + [(500, "oak", []), (501, None, ["M1"])]
    companies, providers = spark.createDataFrame(c, "company_number string, company_name string, postcode string"), spark.createDataFrame(p, "provider_id bigint, provider_name string, postcode_prefixes_list array<string>")
    keyed = [(r.company_number, r.k, r.o) for r in companies.select("company_number", name_key("company_name").alias("k"), outward_code("postcode").alias("o")).collect() if r.o and r.k]
    wanted = [(r.provider_id, r.k, r.postcode_prefixes_list) for r in providers.select("provider_id", name_key("provider_name").alias("k"), "postcode_prefixes_list").collect() if r.k]
    got = matching.consume(matching.candidate_pairs(companies, providers), settle)
    assert {r.provider_id: r.company_number for r in got.collect()} == brute(keyed, wanted)


@pytest.mark.parametrize("one_task_rows", [1_000_000, 0])
def test_copies_of_names_are_paired_as_classes(spark, monkeypatch, one_task_rows):
    """Many members of few classes, companies and providers with several rows: the matches are those of brute force, the pairs those of classes."""
    monkeypatch.setattr(matching, "BLOCK", 4)
    rng = random.Random(4)
    pool = names(rng, 25)
    c = [(f"{k:08d}", rng.choice(pool), f"M{rng.randrange(4)} 1AE") for k in range(300)] + [("77777777", None, "M1 1AE"), (None, "oak", "M1 1AE")]
    p = [(k, rng.choice(pool), [f"M{k % 3}"] if k % 5 else ["M3", "M1", "M3"]) for k in range(250)] + [(500, "oak", []), (501, None, ["M1"])]
    companies, providers = spark.createDataFrame(c, "company_number string, company_name string, postcode string"), spark.createDataFrame(p, "provider_id bigint, provider_name string, postcode_prefixes_list array<string>")
    keyed = [(r.company_number, r.k, r.o) for r in companies.select("company_number", name_key("company_name").alias("k"), outward_code("postcode").alias("o")).collect() if r.o and r.k and r.company_number]
    wanted = [(r.provider_id, r.k, r.postcode_prefixes_list) for r in providers.select("provider_id", name_key("provider_name").alias("k"), "postcode_prefixes_list").collect() if r.k]
    pairs, p_members, c_members = matching._class_pairs(companies, providers, matching.THRESHOLD)
    assert pairs.count() * 3 < matching.candidate_pairs(companies, providers).count()
    assert {r.provider_id: r.company_number for r in matching.settle(pairs, p_members, c_members, one_task_rows).collect()} == brute(keyed, wanted)


def test_groups_of_linked_classes(spark):
    """A chain of pairs is one group, however long; another pair is its own."""
    rng = random.Random(6)
    nodes = rng.sample(range(200), 40)
    chain = [(2 * a, 2 * b + 1) for k in range(39) for a, b in [(nodes[k], nodes[k]), (nodes[k + 1], nodes[k])]]
    found = {r.cls: r.comp for r in matching._groups(spark.createDataFrame(chain + [(1000, 1001)], "pc long, cc long")).collect()}
    assert {found[x] for pair in chain for x in pair} == {min(min(pair) for pair in chain)} and found[1000] == found[1001] == 1000


def test_quantiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(grouping, "SKETCH", 50)
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(size=4000), "b": np.repeat([1.0, 2.0], [3000, 1000]), "c": np.arange(7.0)}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), (None, 3.0)], "k string, x double")
    points = {"low": 0.05, "mid": 0.5, "high": 0.99}
    out = {r.k: r for r in grouping.exact_quantiles(rows, ["k"], "x", points).collect()}
    for k, v in values.items():
        assert out[k].n == len(v) and np.allclose([out[k][n] for n in points], np.quantile(v, list(points.values())))
    assert out[None].mid == 3.0
    whole = grouping.exact_quantiles(rows, [], "x", {"mid": 0.5}).first()
    assert np.isclose(whole.mid, np.median(np.concatenate([*values.values(), [3.0]])))


def test_inserts_with_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", "x")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "c"), (1, "b"), (2, "z"), (2, None), (2, "y")], "k int, v string")
    assert sorted(map(tuple, merges.insert_ignore(old, new, ["k"]).select("k", "v", "w").collect())) == [(1, "a", "x"), (2, None, None)]
    assert sorted(map(tuple, merges.insert_replace(old, new, ["k"]).select("k", "v", "w").collect())) == [(1, "c", "x"), (2, "z", None)]


def test_versions_move_at_once(spark, tmp_path):
    table = Versions(str(tmp_path / "t"))
    assert table.current(spark) is None
    for k in range(3):
        table.publish(spark.range(k + 1), f"v{k}")
        assert table.current(spark).count() == k + 1
    table.publish(spark.range(99), "v2")  # a batch that runs again
    assert table.current(spark).count() == 3
    (tmp_path / "t" / "pointers" / ".new-v9").touch()  # a publisher that died before its rename
    spark.range(50).write.parquet(str(tmp_path / "t" / "v9"))
    assert table.current(spark).count() == 3


def test_ids_over_many_partitions(spark):
    rows = spark.createDataFrame([(k * 7 % 101,) for k in range(101)], "x int").repartition(6)
    out = grouping.with_ids(rows, spark.createDataFrame([(10,)], "id int"), "id", F.col("x")).collect()
    assert sorted((r.x, r.id) for r in out) == [(k, k + 11) for k in range(101)]


def test_uploaded_list(spark):
    out = register.numbered_list(spark, ["123", "abc!", "", "00000123", "sc12", "abc!"]).orderBy("position").collect()
    assert [(r.position, r.company_number) for r in out] == [(0, "00000123"), (1, None), (4, "SC000012"), (5, None)]
    assert len(register.register_columns()) == 60


def test_bands_are_few(spark, monkeypatch):
    monkeypatch.setattr(merges, "MOST_BANDS", 1)
    bands = spark.createDataFrame([(0, 1, 5.0), (2, None, 6.0)], "min_employees int, max_employees int, midpoint_gbp double")
    with pytest.raises(ValueError):
        merges.banded(spark.range(3), "id", bands, ["midpoint_gbp"])
