"""Entity resolution of companies and providers: shared numbers first, then similar names inside an outward code.

Direct matches are equi-joins on numbers.  Fuzzy matching looks at all pairs of distinct names of a block: bounds over a whole block at once, from the
shared words and from the letters that two names have in common, leave few pairs whose edits have to be counted.  Companies and providers that no
comparison can tell apart are a class, and only classes are paired.  Which provider gets a company then follows the rule that providers choose in order of
id, each the best company that is still free, for each group of linked classes by itself.  `consume` does the same from pairs of members: all providers
propose at once to the best company that they haven't lost; a company keeps the least id, and who is refused proposes again.
"""

from __future__ import annotations

from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.codes import name_key, outward_code, registry_number
from ..functions.scores import ladder
from ..functions.similarity import close_pairs, token_set_similarity
from ..session import ship
from .grouping import first_by, small

THRESHOLD, CONFLICT = 90, 89
ONE_TASK_PAIRS = 1_000_000  # pairs that one task settles
ONE_TASK_ROWS = 300_000  # pairs of classes and members that are not worth dealing out
BLOCK = 512  # names of a side that are compared together


def direct_matches(companies: DataFrame, numbers: DataFrame) -> DataFrame:
    """`numbers` (provider_id, source, number): pairs that share a number, 100 and confirmed, or 89 and for review where a provider's sources name several numbers."""
    cleaned = numbers.select("provider_id", "source", registry_number("number").alias("company_number")).where("company_number is not null").distinct()
    several = cleaned.groupBy("provider_id").agg(F.size(F.collect_set("company_number")).alias("n"))
    pairs = cleaned.join(companies.select("company_number").distinct(), "company_number", "left_semi").groupBy("provider_id", "company_number").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    conflict = F.col("n") > 1
    return pairs.join(several, "provider_id").select(
        "company_number", "provider_id", ladder((conflict, CONFLICT), otherwise=100).alias("total_score"), ladder((conflict, "needs_review"), otherwise="auto_confirmed").alias("status"), "sources"
    )


def _compared(threshold: int):
    """Close pairs of one block's names."""

    def run(block: pa.Table) -> pa.Table:
        side = np.asarray(block.column("is_company"))
        c, p = (block.filter(pa.array(mask)) for mask in (side, ~side))
        i, j, ratio = close_pairs(c.column("name").to_pylist(), p.column("name").to_pylist(), threshold)
        return pa.table({"code": c.column("code").take(i), "c_name": c.column("name").take(i), "p_name": p.column("name").take(j), "ratio": pa.array(ratio, pa.int32())})

    return run


def _close_names(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(code, c_name, p_name, ratio) of the distinct (code, name) of both sides.

    The names of a code are cut into blocks of about BLOCK by BLOCK, so that no task gets a code that very many names share.
    """
    parts = lambda df, n: df.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    shape = small(parts(left, "nc").join(parts(right, "np"), "code"))
    own = lambda n: F.pmod(F.xxhash64("name"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(shape, "code").select("code", own("nc").alias("bc"), every("np").alias("bp"), F.lit(True).alias("is_company"), "name")
    b = right.join(shape, "code").select("code", every("nc").alias("bc"), own("np").alias("bp"), F.lit(False).alias("is_company"), "name")
    return a.unionByName(b).groupBy("code", "bc", "bp").applyInArrow(_compared(threshold), "code string, c_name string, p_name string, ratio int")


def _classes(rows: DataFrame, own: str, odd: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (own, code, place, name): the entries (cls, code, place, name) of each class of equal entries, and who is in it (own, cls).

    Classes are numbered evenly or, if `odd` is 1, oddly.
    """
    held = cut(rows.groupBy(own).agg(F.array_sort(F.collect_set(F.struct("code", "place", "name"))).alias("entries")))
    kinds = small(held.select("entries").distinct().select((F.monotonically_increasing_id() * 2 + odd).alias("cls"), "entries"))
    return kinds.select("cls", F.inline("entries")), held.join(kinds, "entries").select(own, "cls")


def _class_pairs(companies: DataFrame, providers: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of classes (pc, cc, place, ratio) with a common outward code and a name similarity at the threshold; members (provider_id, pc) and (company_number, cc).

    Companies of one name and code, and providers of one name and list of codes, are a class: names are compared once, however many share them.
    """
    ship(companies.sparkSession)
    c = companies.select("company_number", outward_code("postcode").alias("code"), F.lit(0).alias("place"), name_key("company_name").alias("name")).where("company_number is not null and code is not null and name <> ''")
    p = providers.select("provider_id", name_key("provider_name").alias("name"), F.posexplode("postcode_prefixes_list").alias("place", "code")).where("provider_id is not null and code <> '' and name <> ''")
    (c, c_members), (p, p_members) = _classes(c, "company_number", 1), _classes(p.groupBy("provider_id", "code", "name").agg(F.min("place").alias("place")), "provider_id", 0)
    near = _close_names(c.select("code", "name").distinct(), p.select("code", "name").distinct(), threshold)
    near = near.join(c.select("code", F.col("name").alias("c_name"), F.col("cls").alias("cc")), ["code", "c_name"]).join(p.select("code", F.col("name").alias("p_name"), F.col("cls").alias("pc"), "place"), ["code", "p_name"])
    pairs = cut(near.groupBy("pc", "cc").agg(F.min("place").alias("place"), F.max("ratio").alias("ratio")))
    return pairs, p_members.withColumnRenamed("cls", "pc"), c_members.withColumnRenamed("cls", "cc")


def candidate_pairs(companies: DataFrame, providers: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs in a common outward code with a name similarity at the threshold, and the place of the code in the provider's list.

    All pairs of the members of close classes: their number is the product of the classes' sizes.
    """
    pairs, p, c = _class_pairs(companies, providers, threshold)
    return pairs.join(p, "pc").join(c, "cc").select("provider_id", "company_number", "place", "ratio")


def _groups(pairs: DataFrame) -> DataFrame:
    """(cls, comp) of all classes that pairs link, directly or over others: the least class number that each one reaches.

    In each round a class, and the class it is numbered after, take the least number of its neighbours, then that of the class they are numbered after,
    until no number changes.
    """
    edges = cut(pairs.select(F.col("pc").alias("a"), F.col("cc").alias("b")).unionByName(pairs.select(F.col("cc").alias("a"), F.col("pc").alias("b"))))
    found, total = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "cls")), None
    while True:
        near = edges.join(found.select(F.col("cls").alias("b"), F.col("comp").alias("low")), "b").groupBy("a").agg(F.min("low").alias("low"))
        near = near.join(found.withColumnRenamed("cls", "a"), "a").select(F.explode(F.array("a", "comp")).alias("cls"), "low").groupBy("cls").agg(F.min("low").alias("low"))
        lower = found.join(near, "cls", "left").select("cls", F.least("comp", "low").alias("old"))
        jumped = lower.join(found.select(F.col("cls").alias("old"), F.col("comp").alias("far")), "old")
        found = cut(jumped.select("cls", F.least("old", "far").alias("comp")))
        last, total = total, found.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == last:  # numbers never rise
            return found


def _settled(batches):
    """Providers in order of id, each the best company that is still free; rows are pairs of classes and members of classes."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return

    def having(name: str, *names: str):
        part = table.filter(table.column(name).is_valid())
        return zip(*(part.column(n).to_pylist() for n in names))

    free: dict[int, list] = {}  # of each class the numbers that are left, the least last
    for cc, number in sorted(having("company_number", "cc", "company_number"), key=lambda x: x[1], reverse=True):
        free.setdefault(cc, []).append(number)
    tiers: dict[int, dict] = {}  # of each class of providers the companies' classes, those that are equally good together
    for pc, cc, place, ratio in having("ratio", "pc", "cc", "place", "ratio"):
        tiers.setdefault(pc, {}).setdefault((-ratio, place), []).append(cc)
    heaps = {}
    for pc, found in tiers.items():  # a heap holds the least number that each class had when last looked at
        heaps[pc] = [(key[0], [(free[cc][-1], cc) for cc in found[key]]) for key in sorted(found, reverse=True)]
        for _, heap in heaps[pc]:
            heapify(heap)
    rows = []
    for provider, pc in sorted(having("provider_id", "provider_id", "pc")):
        mine = heaps[pc]
        while mine:
            ratio, heap = mine[-1]
            number, cc = heap[0]
            left = free[cc]
            if left and left[-1] == number:
                rows.append((provider, left.pop(), -ratio))
                break
            if left:
                heapreplace(heap, (left[-1], cc))
            else:
                heappop(heap)
                if not heap:
                    mine.pop()
    kinds = [table.schema.field(n).type for n in ("provider_id", "company_number", "ratio")]
    yield from pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), kinds)], names=["provider_id", "company_number", "ratio"]).to_batches()


def settle(pairs: DataFrame, p_members: DataFrame, c_members: DataFrame, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(provider_id, company_number, ratio) if providers choose one after the other by id, from pairs of classes.

    Classes that no pair links have no company in common, so tasks get whole linked groups, all in one task if there are at most `one_task_rows`
    pairs and members.  A task holds the pairs of classes and the members of its groups, not the pairs of members.
    """
    few = pairs.count() + p_members.count() + c_members.count() <= one_task_rows
    classes = pairs.select(F.col("pc").alias("cls")).unionByName(pairs.select(F.col("cc").alias("cls"))).distinct()
    groups = small(classes.withColumn("comp", F.lit(0).cast("long")) if few else _groups(pairs))
    comp = lambda n: groups.select(F.col("cls").alias(n), "comp")
    kinds = dict(p_members.dtypes) | dict(c_members.dtypes)
    none = lambda n: F.lit(None).cast(kinds[n] if n in kinds else "int").alias(n)
    rows = pairs.join(comp("pc"), "pc").select("comp", none("provider_id"), none("company_number"), "pc", "cc", "place", "ratio")
    rows = rows.unionByName(p_members.join(comp("pc"), "pc").select("comp", "provider_id", none("company_number"), "pc", F.lit(None).cast("long").alias("cc"), none("place"), none("ratio")))
    rows = rows.unionByName(c_members.join(comp("cc"), "cc").select("comp", none("provider_id"), "company_number", F.lit(None).cast("long").alias("pc"), "cc", none("place"), none("ratio")))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(1 if few else n, "comp").drop("comp").mapInArrow(_settled, f"provider_id {kinds['provider_id']}, company_number {kinds['company_number']}, ratio int")


def _in_turn(batches):
    """Providers in order of id, each the best company that is still free."""
    table = pa.Table.from_batches(list(batches))
    if table.num_rows:
        table = table.sort_by([("provider_id", "ascending"), ("ratio", "descending"), ("place", "ascending"), ("company_number", "ascending")])
        taken, settled, rows = set(), None, []
        for row, (provider, company) in enumerate(zip(table.column("provider_id").to_pylist(), table.column("company_number").to_pylist())):
            if provider != settled and company not in taken:
                taken.add(company)
                settled = provider
                rows.append(row)
        yield from table.take(rows).select(["provider_id", "company_number", "ratio"]).to_batches()


def consume(pairs: DataFrame, one_task_pairs: int = ONE_TASK_PAIRS) -> DataFrame:
    """(provider_id, company_number, ratio): the pairs that result if providers choose one after the other by id.

    In each round every provider's best remaining pair is its proposal and a company holds the least proposer; pairs of greater ids
    with a held company can't come about any more and go.  Remaining pairs are checkpointed between rounds; once there are no more than
    `one_task_pairs`, one task lets the providers choose in turn, which gives the same pairs.
    """
    left = cut(pairs)
    while left.count() > one_task_pairs:
        best = first_by(left, "provider_id", F.desc("ratio"), F.col("place"), F.col("company_number"))
        held = cut(best.groupBy("company_number").agg(F.min("provider_id").alias("_holder"), F.count("*").alias("_n")))
        if held.where("_n > 1").isEmpty():
            return best.select("provider_id", "company_number", "ratio")
        left = cut(left.join(held.drop("_n"), "company_number", "left").where("_holder is null or provider_id <= _holder").drop("_holder"))
    ship(pairs.sparkSession)
    kinds = dict(pairs.dtypes)
    return left.select("provider_id", "company_number", "place", "ratio").coalesce(1).mapInArrow(_in_turn, ", ".join(f"{c} {kinds[c]}" for c in ("provider_id", "company_number", "ratio")))


def fuzzy_matches(companies: DataFrame, providers: DataFrame, direct: DataFrame) -> DataFrame:
    """Matches by name of what has no direct match; the stored score is the threshold."""
    free_c = companies.join(direct.select("company_number"), "company_number", "left_anti")
    free_p = providers.join(direct.select("provider_id"), "provider_id", "left_anti")
    return settle(*_class_pairs(free_c, free_p, THRESHOLD)).select("company_number", "provider_id", F.lit(THRESHOLD).alias("total_score"), F.lit("auto_confirmed").alias("status"), F.col("ratio").alias("name_ratio"))


def annotations(matches: DataFrame, companies: DataFrame, providers: DataFrame, previous: list[str]) -> DataFrame:
    """Signals beside a score that never change it: best earlier name, missing postcodes, and a better ratio of aggressively cleaned names."""
    ship(matches.sparkSession)
    joined = matches.join(companies, "company_number").join(providers, "provider_id")
    names = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c)) for c in previous)))
    out = joined.select("*", F.posexplode_outer(names).alias("_at", "_old"))
    out = out.withColumn("_old_ratio", token_set_similarity(name_key("_old"), name_key("provider_name")))
    out = first_by(out, ["company_number", "provider_id"], F.desc("_old_ratio"), F.col("_at"))
    plain = out.withColumn("_ratio", token_set_similarity(name_key("company_name"), name_key("provider_name"))).withColumn("_bold", token_set_similarity(name_key("company_name", True), name_key("provider_name", True)))
    no_company, no_provider = outward_code("postcode").isNull(), F.coalesce(F.size("postcode_prefixes_list"), F.lit(0)) <= 0
    return plain.select(
        *matches.columns,
        F.when((F.col("_old_ratio") >= THRESHOLD), F.col("_old")).alias("previous_name"),
        ladder((no_company & no_provider, "company_and_provider_missing_postcode"), (no_company, "company_missing_postcode"), (no_provider, "provider_missing_postcode")).alias("missing_postcode"),
        F.when((F.col("_bold") >= THRESHOLD) & (F.col("_bold") > F.col("_ratio")), F.col("_bold")).alias("aggressive_ratio"),
    )


def summary(companies: DataFrame, providers: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of what was considered and found."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    found = matches.agg(F.count("*").alias("matches"), F.count_if(F.col("status") == "needs_review").alias("needs_review"))
    return count(companies, "companies_considered").crossJoin(count(providers, "providers_considered")).crossJoin(found)
