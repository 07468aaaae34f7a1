"""One object over a folder of register tables: reads with filters and pages, loads behind gates, exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import grouping, matching, places, reading, register, scoring, snapshots
from .operators.snapshots import Versions
from .sources import readers, sinks

TABLES = ("companies", "locations", "providers", "listed", "matches", "enrichment", "classifications", "exclusions", "exclusion_lists")


@dataclass
class Register:
    """Tables as versions below `root`; each method returns a frame, a count, or the figures of a gate."""

    spark: SparkSession
    root: str

    def versions(self, name: str) -> Versions:
        if name not in TABLES:
            raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
        return Versions(f"{self.root.rstrip('/')}/{name}")

    def table(self, name: str) -> DataFrame:
        found = self.versions(name).current(self.spark)
        if found is None:
            raise FileNotFoundError(f"{name} hasn't been loaded")
        return found

    def load_companies(self, paths: list[str], columns: list[str], force: bool = False) -> dict:
        """A monthly bulk file in: rejected lines counted, the gate enforced, history kept."""
        month = readers.one_month(paths)
        raw = readers.read_csv(self.spark, paths, columns)
        return self.load("companies", register.register_rows(readers.good_rows(raw)), "company_number", month, force) | {"rejected": readers.rejected_rows(raw).first().rejected}

    def load(self, name: str, staging: DataFrame, key: str, month: str, force: bool = False) -> dict:
        """A full snapshot merged into a table; the first one only has to have unique keys."""
        table = self.versions(name)
        old = table.current(self.spark)
        if old is None:
            figures = snapshots.enforce(snapshots.gate_figures(snapshots.bootstrap(staging.limit(0), month), staging, key), True)
            table.publish(snapshots.bootstrap(staging, month), f"m{month}")
        else:
            figures = snapshots.enforce(snapshots.gate_figures(old, staging, key), force)
            table.publish(snapshots.upsert(old, staging, key, month), f"m{month}")
        return figures

    def companies(self, search: str | None = None, status: str | None = None, sic_codes=None, postcode_prefix: str | None = None, is_active: bool | None = None, sort_by: str = "company_name", descending: bool = False, page: int = 1, page_size: int = 50) -> tuple[DataFrame, int]:
        """A page of companies and how many there are."""
        codes = [f"sic_code_{k}" for k in range(1, 5)]
        wanted = reading.both(
            reading.contains_any_case(["company_name"], search),
            reading.equals("company_status", status),
            reading.any_of(codes, sic_codes) if sic_codes else None,
            reading.starts("postcode", postcode_prefix),
            reading.equals("is_active", is_active),
        )
        allowed = {c: F.col(c) for c in ("company_name", "company_number", "postcode", "incorporation_date")}
        return reading.page_and_total(self.table("companies").where(wanted), reading.sort_keys(allowed, sort_by, "company_name", descending, "company_number"), page, page_size)

    def locations(self, page: int = 1, page_size: int = 50, **filters) -> tuple[DataFrame, int]:
        keys = reading.sort_keys({"name": F.col("name")}, "name", "name", False, "location_id")
        return reading.page_and_total(self.table("locations").where(places.location_filter(**filters)), keys, page, page_size)

    def providers(self, page: int = 1, page_size: int = 50, **filters) -> tuple[DataFrame, int]:
        keys = reading.sort_keys({"provider_name": F.col("provider_name")}, "provider_name", "provider_name", False, "provider_id")
        return reading.page_and_total(self.table("providers").where(places.provider_filter(**filters)), keys, page, page_size)

    def roll_up(self) -> int:
        """The providers table from the locations."""
        out = grouping.rollup(self.table("locations"))
        self._next("providers", out)
        return self.table("providers").count()

    def match(self, numbers: DataFrame, mode: str = "all") -> DataFrame:
        """Direct and fuzzy matches, kept beside what users have decided; a row of counts."""
        from .operators.merges import keep_locked

        companies, providers = self.table("companies").where("is_active"), self.table("providers").where("is_active")
        direct = matching.direct_matches(companies, numbers)
        found = direct.select("company_number", "provider_id", "total_score", "status").unionByName(matching.fuzzy_matches(companies, providers, direct).select("company_number", "provider_id", "total_score", "status"))
        old = self.versions("matches").current(self.spark)
        self._next("matches", found if old is None else keep_locked(old, found, ["company_number", "provider_id"], companies.select("company_number"), mode))
        return matching.summary(companies, providers, self.table("matches"))

    def targets(self, tiers: tuple[str, ...] | None = ("Tier 1", "Tier 2", "Tier 3")) -> DataFrame:
        """Scored and tiered companies."""
        t = {n: self.table(n) for n in ("companies", "matches", "locations", "enrichment", "classifications", "exclusions", "exclusion_lists")}
        out = scoring.tiered_targets(t["companies"], t["matches"], t["locations"], t["locations"], t["enrichment"], t["classifications"], t["exclusions"], t["exclusion_lists"])
        return scoring.tier_filter(out, tiers)

    def report(self, written: list[str], year: int) -> DataFrame:
        """The report of an uploaded list."""
        return register.report_rows(register.numbered_list(self.spark, written), self.table("companies"), self.table("enrichment"), year)

    def export(self, name: str, path: str, form: str = "csv") -> int:
        """A table as CSV, Parquet bundle or SQLite file; returns the row count."""
        df = self.table(name)
        if form == "csv":
            flat = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
            return sinks.write_csv(df.select(*flat), path)
        if form == "bundle":
            return sinks.write_bundle({name: df}, path)[name]
        if form == "sqlite":
            return sinks.write_sqlite(df, path, name)
        raise ValueError(f"form {form!r}")

    def _next(self, name: str, df: DataFrame) -> None:
        table = self.versions(name)
        last = table._last(self.spark)
        table.publish(df, f"n{last[0] + 1 if last else 0:08d}")
