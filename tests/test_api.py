"""The facade and the command line over a small register."""

import json

import pytest

from tallyframe import cli
from tallyframe.api import Register
from tallyframe.operators.snapshots import GateError
from tallyframe.sources import readers, sinks


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = Register(spark, str(tmp_path_factory.mktemp("register")))
    rows = [(f"{k:08d}", f"Company {k}", "Active", "88100" if k % 2 else None, f"M{k % 3} 1AE", None) for k in range(30)]
    names = "company_number string, company_name string, company_status string, sic_code_1 string, postcode string, incorporation_date date"
    companies = spark.createDataFrame(rows, names)
    for k in range(2, 5):
        companies = companies.selectExpr("*", f"CAST(NULL AS STRING) AS sic_code_{k}")
    assert out.load("companies", companies, "company_number", "2026-01-01")["new_total"] == 30
    places = [(str(k), f"Home {k}", "Homecare agencies", "North", "Leeds", str(k % 5), f"Provider {k % 5}", f"M{k % 3} 1AE", k % 4 != 0, None, None, None) for k in range(20)]
    out.versions("locations").publish(spark.createDataFrame(places, "location_id string, name string, service_types string, region string, local_authority string, provider_id string, provider_name string, postcode string, is_active boolean, first_scrape_date date, last_scrape_date date, marked_inactive_scrape_date date"), "v0")
    return out


def test_reads(store):
    rows, total = store.companies(search="company 1", sic_codes="88100", is_active=True, page_size=3)
    assert total == 6 and [r.company_number for r in rows.collect()] == ["00000001", "00000011", "00000013"]
    assert store.roll_up() == 5 and store.providers(service_types="Homecare agencies", min_active_location_count=3)[1] == 5 and store.providers(min_active_location_count=4)[1] == 0
    assert store.locations(is_active=False, postcode_prefix="M0")[1] == 2
    with pytest.raises(FileNotFoundError):
        store.table("matches")
    with pytest.raises(ValueError):
        store.table("nothing")


def test_a_load_that_loses_too_much_is_refused(store, spark):
    now = store.table("companies")
    few = now.select(*[c for c in now.columns if c not in ("is_active", "first_scrape_date", "last_scrape_date", "marked_inactive_scrape_date", "last_enriched_at")]).where("company_number < '00000020'")
    with pytest.raises(GateError):
        store.load("companies", few, "company_number", "2026-02-01")
    store.load("companies", few, "company_number", "2026-02-01", force=True)
    assert store.companies(is_active=False)[1] == 10 and store.companies()[1] == 30


def test_command_line(store, tmp_path):
    parsed = cli.parser().parse_args([store.root, "companies", "--search", "company 2", "--page-size", "2"])
    lines = cli.run(parsed, store)
    assert json.loads(lines[-1]) == {"total": 11} and len(lines) == 3
    parsed = cli.parser().parse_args([store.root, "export", "companies", str(tmp_path / "out"), "--form", "csv"])
    assert json.loads(cli.run(parsed, store)[0]) == {"rows": 30}


def test_small_files_and_old_shapes(spark, tmp_path):
    spark.range(50).repartition(20).write.parquet(str(tmp_path / "many"))
    assert sinks.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"), 2) == 50 and len(spark.read.parquet(str(tmp_path / "few")).inputFiles()) <= 2
    old = spark.createDataFrame([(1, "a", 7), (2, "b", 8)], "id int, title string, parent int")
    new = readers.migrated(old, {"title": "name", "gone": "x"}, "id int, name string, parent int, seen date", {"parent": (spark.createDataFrame([(7,)], "k int"), "k")})
    assert sorted(tuple(r) for r in new.select("id", "name", "parent", "seen").collect()) == [(1, "a", 7, None), (2, "b", None, None)]
    (tmp_path / "rows.json").write_text('{"a": 1, "b": [2]}\n{"a": 3}\n')
    found = readers.read_inferred(spark, str(tmp_path / "rows.json"), "a long, c string")
    assert dict(found.dtypes)["b"] == "array<bigint>" and found.where("c is null").count() == 2
    (tmp_path / "head.csv").write_text("n,v\n")
    assert readers.from_header(spark, str(tmp_path / "head.csv"), {"n": "int"}).dtypes == [("n", "int"), ("v", "string")]
