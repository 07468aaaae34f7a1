"""URL filters: a trie over reversed host labels, and below each host one over path segments.

Allow and block entries share the trie; the longest entry that fits a URL decides.
Rule lists of bounded length go to the executors as a trie, inside the function that each task gets; beyond `max_rules` the rules are a
table and the lookup is an equi-join on the suffixes and prefixes that occur in it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .spark_io import free_name

MAX_RULES = 200_000
SALTS = 16  # copies of a table that is joined with hot keys
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        k = rest.find(mark)
        if k >= 0:
            rest = rest[:k]
    k = rest.find("/")
    host, path = (rest, "") if k < 0 else (rest[:k], rest[k:])
    return host.translate(_FOLD), path


class RuleTrie:
    """Rules (verdict, 'host/path').  A rule fits its host and all subdomains if the path starts with the rule's path.

    Longest means: more host labels first, then the longer path.  Of an allow and a block entry
    for the same host and path, block wins.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.hosts: dict = {}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            node = self.hosts
            for label in reversed(host.translate(_FOLD).split(".")):
                node = node.setdefault(label, {})
            paths = node.setdefault(None, {})
            *whole, tail = (slash + path).split("/")
            for segment in whole:
                paths = paths.setdefault(segment, {})
            tails = paths.setdefault(None, {}).setdefault(len(tail), {})
            if tails.get(tail, ("allow",))[0] != "block":
                tails[tail] = (verdict, host.translate(_FOLD) + slash + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits, or None."""
        found, node = [], self.hosts
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                found.append(node[None])
        for paths in reversed(found):
            best = self._path(paths, path)
            if best:
                return best
        return None

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            for size, tails in sorted(node.get(None, {}).items()):
                best = tails.get(path[at : at + size]) or best if at + size <= len(path) else best
            end = path.find("/", at)
            if end < 0 or (node := node.get(path[at:end])) is None:
                return best
            at = end + 1


def _judge(trie: RuleTrie, default: str, position: int):
    def run(batches):
        for batch in batches:
            out = [(host, path, *(trie.find(host, path) or (default, None))) for host, path in map(split_url, batch.column(position).to_pylist())]
            hosts, paths, verdicts, rules = zip(*out) if out else ((),) * 4
            extra = [pa.array(c, pa.string()) for c in (hosts, paths, rules, verdicts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[str(k) for k in range(len(batch.columns) + 4)])

    return run


def checked_rules(rules: DataFrame) -> DataFrame:
    """(verdict, rule) of the rules that name anything: a null or empty rule is left out; another verdict than allow and block is an error."""
    odd = rules.where("rule is not null and rule <> '' and (verdict is null or verdict not in ('allow', 'block'))").select("verdict").first()
    if odd:
        raise ValueError(f"verdict {odd.verdict!r}")
    return rules.select("verdict", "rule").where("rule is not null and rule <> ''")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """`pages`, all columns, with host, path, rule and verdict (existing columns of these names are replaced).

    `rules`: (verdict, 'host/path') pairs or a frame with columns verdict and rule, checked by `checked_rules`.  `rule` is null and the verdict is
    `default` where nothing fits.  A null URL and one without '://' have an empty host and path.  An empty
    rule list gives every URL the default.  Repeated rows are judged one by one; repeated rules count once, and block wins over
    allow for one host and path.  URLs of any length are judged whole.  Up to `max_rules` rules go along as a trie, more are looked up in a join
    with the same results.
    """
    spark = pages.sparkSession
    ship(spark)
    base = pages.drop("host", "path", "rule", "verdict")
    table = checked_rules(rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule string"))
    listed = table.limit(max_rules + 1).collect()  # one more than may be sent decides
    if len(listed) > max_rules:
        return _judge_by_join(base, table, url_col, default)
    trie = RuleTrie([(r.verdict, r.rule) for r in listed])
    names = [free_name(base, n) for n in ("host_", "path_", "rule_", "verdict_")]
    schema = ", ".join([f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(base.schema)] + [f"`{n}` string" for n in names])
    return base.mapInArrow(_judge(trie, default, base.columns.index(url_col)), schema).toDF(*base.columns, "host", "path", "rule", "verdict")


def _salts(df: DataFrame) -> DataFrame:
    return df.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _judge_by_join(base: DataFrame, table: DataFrame, url_col: str, default: str) -> DataFrame:
    """The same verdicts by an equi-join: each distinct host suffix and path prefix of a URL, of the lengths that rules have, against the rules.

    Hosts under one suffix, and rows of one URL, may be a large share of all: their side is dealt by a salt, the other one goes along SALTS times.
    """
    fold = lambda c: F.translate(c, UPPER, LOWER)
    row = free_name(base, "row_")
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^?#]*", 0)).otherwise(F.lit(""))
    marked = base.withColumn("host", fold(F.regexp_extract(rest, r"^[^/]*", 0))).withColumn("path", F.regexp_extract(rest, r"^[^/]*([\s\S]*)$", 1))
    marked = marked.withColumn(row, F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("int"))
    slash = F.instr("rule", "/")
    table = table.select(
        "verdict",
        fold(F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))).alias("r_host"),
        F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit("")).alias("r_path"),
    )
    table = table.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
    sizes = _salts(table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("sizes")))
    labels = F.split("host", r"\.")
    keys = marked.select("host", "path").distinct().withColumn("salt_", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = keys.withColumn("r_host", F.explode(suffixes)).join(sizes, ["r_host", "salt_"])
    keys = keys.select("host", "path", "r_host", F.explode("sizes").alias("n")).where("n <= length(path)").withColumn("r_path", F.expr("substring(path, 1, n)"))
    keys = keys.withColumn("salt_", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    hits = keys.join(_salts(table), ["r_host", "r_path", "salt_"])
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("r_verdict", F.concat("r_host", "r_path").alias("rule")), F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"))).alias("best"))
    best = best.withColumn(row, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return marked.join(best, ["host", "path", row], "left").select(*base.columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
