import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import facts, grouping, matching, merges, reading, scoring, snapshots

D = dt.date


def ids(spark, keys, name="n"):
    return spark.createDataFrame([(k, f"{name}{k}") for k in keys], "id long, name string")


def test_upsert_months(spark):
    first = snapshots.bootstrap(ids(spark, range(1, 101)), "2024-01-01")
    second = snapshots.upsert(first, ids(spark, range(5, 101), "m"), "id", "2024-02-01")
    third = snapshots.upsert(second, ids(spark, range(9, 101)), "id", "2024-03-01")
    rows = {r.id: r for r in third.collect()}
    assert len(rows) == 100 and sum(r.is_active for r in rows.values()) == 92
    assert rows[1].marked_inactive_scrape_date == D(2024, 2, 1) and rows[1].name == "n1" and rows[6].marked_inactive_scrape_date == D(2024, 3, 1) and rows[6].name == "m6"
    assert rows[50].first_scrape_date == D(2024, 1, 1) and rows[50].last_scrape_date == D(2024, 3, 1)
    again = snapshots.upsert(third, ids(spark, range(9, 101)), "id", "2024-03-01")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, third.collect()))


def test_gates(spark):
    old = snapshots.bootstrap(ids(spark, range(1, 101)), "2024-01-01")
    snapshots.enforce(snapshots.gate_figures(old, ids(spark, range(5, 101)), "id"))
    cut = snapshots.gate_figures(old, ids(spark, range(1, 81)), "id")
    with pytest.raises(snapshots.GateError):
        snapshots.enforce(cut)
    assert snapshots.enforce(cut, force=True)["inactive_pct"] == 20.0
    with pytest.raises(snapshots.GateError):
        snapshots.enforce(snapshots.gate_figures(old, ids(spark, [1, 1, *range(2, 101)]), "id"), force=True)
    assert snapshots.gate_figures(old.limit(0), ids(spark, [1]), "id").first().row_pct is None


def test_replace_gate(spark):
    rows = spark.createDataFrame([(f"l{k}", "x" if k < 3 else None) for k in range(5)], "id string, number string")
    assert snapshots.replace_gate(5, rows, "id", "number")["filled_pct"] == 60.0
    for bad, old in ((rows.limit(0), 5), (rows.unionByName(rows), 5)):
        with pytest.raises(snapshots.GateError):
            snapshots.replace_gate(old, bad, "id", "number", force=True)
    with pytest.raises(snapshots.GateError):
        snapshots.replace_gate(5, rows.withColumn("number", F.lit(None).cast("string")), "id", "number")


def test_versions(spark, tmp_path):
    table = snapshots.Versions(str(tmp_path / "t"))
    assert table.current(spark) is None
    table.publish(ids(spark, [1]), "v1")
    table.publish(ids(spark, [1, 2]), "v2")
    assert table.current(spark).count() == 2


def test_matcher(spark):
    companies = spark.createDataFrame([("87654321", "Bright Support Limited", "SW1A 1AA"), ("11111111", "ABC Cars Ltd", "M1 1AE"), ("66666666", "Six Homes", "B1 1AA")], "company_number string, company_name string, postcode string")
    providers = spark.createDataFrame([("prov-2", "Bright Support Ltd", ["SW1A"]), ("prov-3", "ABC Care Services Ltd", ["M1"]), ("prov-7a", "Six", ["B1"]), ("prov-7b", "Six", ["B1"]), ("prov-9", "Nine", None)], "provider_id string, provider_name string, postcode_prefixes_list array<string>")
    numbers = spark.createDataFrame([("prov-7a", "hsca", "66666666"), ("prov-7b", "hsca", "66666666"), ("prov-7b", "api", "99")], "provider_id string, source string, number string")
    direct = matching.direct_matches(companies, numbers)
    assert sorted((r.provider_id, r.total_score, r.status) for r in direct.collect()) == [("prov-7a", 100, "auto_confirmed"), ("prov-7b", 89, "needs_review")]
    fuzzy = matching.fuzzy_matches(companies, providers, direct)
    assert [(r.company_number, r.provider_id, r.total_score) for r in fuzzy.collect()] == [("87654321", "prov-2", 90)]
    named = companies.withColumn("prev_name_1", F.when(F.col("company_number") == "87654321", "Old Name"))
    row = matching.annotations(fuzzy, named, providers, ["prev_name_1"]).first()
    assert row.previous_name is None and row.missing_postcode is None


def test_consume_follows_provider_order(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        edges = sorted({(p, f"c{rng.randrange(6)}") for p in range(8) for _ in range(3)})
        rows = [(p, c, rng.randrange(3), rng.randrange(90, 100)) for p, c in edges]
        taken, want = set(), {}
        for p in sorted({r[0] for r in rows}):
            free = sorted((-r[3], r[2], r[1]) for r in rows if r[0] == p and r[1] not in taken)
            if free:
                want[p] = free[0][2]
                taken.add(free[0][2])
        got = matching.consume(spark.createDataFrame(rows, "provider_id int, company_number string, place int, ratio int"))
        assert {r.provider_id: r.company_number for r in got.collect()} == want


def test_best_match_tie_by_sites(spark):
    m = spark.createDataFrame([("c", "a", "auto_confirmed", 100, 1), ("c", "b", "auto_confirmed", 100, 1), ("c", "x", "user_rejected", 100, 1)], "company_number string, provider_id string, status string, total_score int, matched_at int")
    sites = spark.createDataFrame([("a",), ("b",), ("b",)], "provider_id string")
    assert [r.provider_id for r in grouping.best_match(m, sites).collect()] == ["b"]


def test_figures_merge_modes(spark):
    types = {c: "double" for c in merges.FIGURES} | {"employee_count": "int", "filing_period_start": "date", "filing_period_end": "date", "filing_id": "string", "filing_format": "string", "filing_age_months": "int"}
    figures = lambda d: tuple(d.get(c) for c in merges.FIGURES)
    head = "company_number string, " + ", ".join(f"{c} {t}" for c, t in types.items())
    stored = spark.createDataFrame(
        [("r", *figures({"revenue": 5.0, "net_assets": 1.0, "filing_id": "a"}), "filed_accounts_pdf", 1), ("o", *figures({"revenue": 5.0, "filing_id": "a"}), "filed_accounts_ocr_pdf", 2), ("g", *figures({"revenue": 5.0}), "estimate", 3), ("s", *figures({}), None, 4)],
        head + ", revenue_source string, avg_director_age int",
    ).withColumn("last_enriched_at", F.lit(None).cast("timestamp"))
    t = dt.datetime(2024, 1, 1)
    staged = spark.createDataFrame(
        [("r", *figures({"revenue": 7.0, "filing_id": "b", "filing_format": "ixbrl"}), "ok", False, t), ("r", *figures({"revenue": 1.0, "filing_id": "z"}), "ok", False, t - dt.timedelta(1)), ("o", *figures({"filing_id": "a"}), "pdf_no_text_layer", False, t), ("g", *figures({"net_assets": 2.0}), "request_error", False, t), ("n", *figures({"employee_count": 3, "filing_id": "q"}), "partial", True, t)],
        head + ", parse_status string, profit_loss_exempt boolean, fetched_at timestamp",
    )
    rows = {r.company_number: r for r in merges.merge_figures(stored, staged).collect()}
    assert (rows["r"].revenue, rows["r"].net_assets, rows["r"].revenue_source, rows["r"].avg_director_age) == (7.0, None, "filed_accounts_ixbrl", 1)
    assert (rows["o"].revenue, rows["o"].revenue_source) == (5.0, "filed_accounts_ocr_pdf")
    assert (rows["g"].revenue, rows["g"].net_assets, rows["g"].revenue_source) == (5.0, 2.0, "estimate")
    assert (rows["n"].employee_count, rows["n"].revenue_source) == (3, "partial_no_revenue")
    assert rows["s"].last_enriched_at is None and len(rows) == 5


def test_limits_pages_and_lists(spark):
    assert [reading.checked_limit(x) for x in (None, 0, 3)] == [None, 0, 3]
    for bad in (-1, True, "3", 1.5):
        with pytest.raises(ValueError):
            reading.checked_limit(bad)
    with pytest.raises(ValueError):
        reading.any_of(["a"], " , ")
    with pytest.raises(ValueError):
        reading.page(ids(spark, [1]), [F.col("id")], 0)
    rows = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "a")], "id long, v string")
    for down, want in ((False, [3, 4, 2, 1]), (True, [2, 3, 4, 1])):
        assert [r.id for r in rows.orderBy(*reading.sort_keys({"v": F.col("v"), "id": F.col("id")}, "v", "id", down, "id")).collect()] == want
    lists = spark.createDataFrame([(["a", None],), ([None],), (None,)], "l array<string>")
    assert [r[0] for r in lists.select(reading.list_has_any("l", ["a"])).collect()] == [True, False, False]


def test_tiers(spark):
    base = spark.createDataFrame(
        [("T1", "Majority domiciliary", True, False, False, 60, 2, False, 5e6), ("T2", "Majority domiciliary", False, False, False, None, 0, None, 1.2e6), ("T3", "Mixed_domiciliary_supported", False, False, False, None, 1, None, None), ("T4", None, False, False, False, None, 0, None, None)],
        "name string, verdict string, has_homecare boolean, has_supported_living boolean, has_residential boolean, avg_director_age int, directors_over_60 int, all_directors_60_plus boolean, revenue double",
    )
    out = scoring.scored(base)
    assert {r.name: r.tier for r in out.collect()} == {"T1": "Tier 1", "T2": "Tier 2", "T3": "Tier 3", "T4": "Excluded"}
    assert scoring.tier_filter(out).count() == 3 and scoring.tier_filter(out, None).count() == 4


def test_facts(spark):
    schema = "doc_id string, name string, value double, instant date, startdate date, enddate date, members array<string>"
    rows = [
        ("d", "Turnover", 10.0, None, D(2023, 1, 1), D(2023, 12, 31), []), ("d", "Turnover", 9.0, None, D(2022, 1, 1), D(2022, 12, 31), []), ("d", "Turnover", 99.0, None, D(2023, 1, 1), D(2023, 12, 31), ["Segment"]),
        ("d", "Creditors", -5.0, D(2023, 12, 31), None, None, ["WithinOneYear"]), ("d", "Creditors", 7.0, D(2022, 12, 31), None, None, ["WithinOneYear"]), ("d", "Creditors", 8.0, D(2023, 12, 31), None, None, ["AfterOneYear"]),
        ("e", "NetAssets", 1.0, D(2023, 6, 30), None, None, []),
    ]
    f = spark.createDataFrame(rows, schema)
    assert facts.pick(f, ["Turnover"]).first().value == 10.0
    assert facts.at_balance_sheet(f, ["Creditors"], ["WithinOneYear"], need_member=True).select(facts.liability("value")).first()[0] == 5.0
    got = {r.doc_id: (r.period_start, r.period_end) for r in facts.period_bounds(f, ["Turnover"], ["NetAssets"], [["Turnover"]]).collect()}
    assert got == {"d": (D(2023, 1, 1), D(2023, 12, 31)), "e": (None, D(2023, 6, 30))}
    named = spark.createDataFrame([(["explicitMember core:Dim core:WithinOneYear", ""],)], "s array<string>")
    assert named.select(facts.local_members("s")).first()[0] == ["WithinOneYear"]


def test_fuzzy_query_matches_the_whole_table(spark, tmp_path):
    """Against providers that choose one after the other among all companies of their block."""
    from pyspark.sql import functions as F

    from tallyframe.functions.codes import name_key
    from tallyframe.functions.similarity import token_set_ratio
    from tallyframe.plans.text_queries import fuzzy_match

    names = ["large ring", "hot bolt", "old plate", "hot plate", "cold gear"]
    parts = spark.createDataFrame([(k, names[k * 7 % 5], f"Brand#{k * 5 % 13}", 1 + k * 3 % 4) for k in range(60)], "p_partkey long, p_name string, p_brand string, p_size int")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    full = F.concat("p_name", F.lit(" "), "p_brand")
    rows = parts.select("p_partkey", "p_size", name_key(F.concat(full, F.lit(" Limited"))), name_key(F.concat(F.lit("The "), full, F.lit(" Ltd")))).collect()
    free, want = {k: (size, name) for k, size, name, _ in rows}, set()
    for k, size, _, name in sorted(rows):
        near = [(-round(token_set_ratio(c, name)), f"{n:08d}", n) for n, (s, c) in free.items() if s == size]
        near = [x for x in near if x[0] <= -90]
        if near:
            want.add((min(near)[1], k))
            del free[min(near)[2]]
    got = fuzzy_match(spark, str(tmp_path)).collect()
    assert sorted((r.company_number, r.provider_id) for r in got) == sorted(want) and len({p % 4 for _, p in want}) == 4
