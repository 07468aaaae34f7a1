"""Near-duplicate documents: one-permutation hashing, optimal densification, banded buckets, star edges.

1.  One Arrow pass hashes each text's word shingles (64 bits) and keeps a 128-bit
    digest of the set, its size, and 32 band keys of 4 densified bins each.
    Two sets of Jaccard similarity 0.8 share no band with probability 5e-8.
2.  Equal sets fall into one class by digest; only class representatives go on.
3.  In each bucket every member is compared with a centre, on full sets.  A star has two levels, so that no bucket and no
    centre is more than a small share of one task's rows however many members it has: a bucket's members are dealt
    by hash into SPLIT parts, each with its own centre, and these centres have one centre in turn.
    Members of a bucket that are in several components after that are compared
    exactly, in blocks bounded by rows and by bytes; one link for each query and component leaves a block.
4.  Components of the links give the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .components import connected_components
from .spark_io import cut, free_name
from .vectext import mix, scan_words, shingle_hashes, slices_of

BINS, BANDS = 128, 32
ROWS = BINS // BANDS
BLOCK, BLOCK_SHINGLES = 128, 1 << 20  # rows of a side of a block, and shingles that it should hold at most
SPLIT, SALTS = 1024, 16  # parts of a bucket with a centre each; copies of a small side that is joined with hot keys
_U = np.uint64
_TOP = _U(2**64 - 1)
_ATTEMPTS = np.random.Generator(np.random.PCG64(7)).integers(0, BINS, (4 * BINS, BINS))


def shingle_sets(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside it, and where each text's begin (n + 1 bounds)."""
    hashes, texts = shingle_hashes(scan_words(column), size)
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    hashes, texts = hashes[new], texts[new]
    return hashes, np.searchsorted(texts, np.arange(len(column) + 1))


def densified(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One value per text and bin: the least hash there; an empty bin copies the first non-empty one of its own random sequence."""
    n = len(bounds) - 1
    texts = np.repeat(np.arange(n), np.diff(bounds))
    least = np.full(n * BINS, _TOP)
    np.minimum.at(least, texts * BINS + (hashes >> _U(57)).astype(np.int64), mix(hashes))
    least = least.reshape(n, BINS)
    out = least.copy()
    left = np.flatnonzero((least == _TOP).any(axis=1) & (np.diff(bounds) > 0))
    for a in range(5 * BINS):
        if not len(left):
            break
        to = _ATTEMPTS[a] if a < len(_ATTEMPTS) else (np.arange(BINS) + a) % BINS
        rows = out[left]
        rows = np.where(rows == _TOP, least[left][:, to], rows)
        out[left] = rows
        left = left[(rows == _TOP).any(axis=1)]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), (len(values), BANDS)).copy()
    grouped = values.reshape(len(values), BANDS, ROWS)
    for j in range(ROWS):
        keys = mix(keys * _U(0xD1342543DE82EF95) + grouped[:, :, j])
    return keys


def set_digests(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set, from two sums over its members."""
    total = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes ^ _U(k)))]) for k in (0x1234567, 0x89ABCDEF01)]
    sums = np.stack([mix(t[bounds[1:]] - t[bounds[:-1]] + np.diff(bounds).astype(_U)) for t in total], axis=1)
    return [row.tobytes() for row in sums]


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                part = batch.slice(a, z - a)
                hashes, bounds = shingle_sets(part.column(1), size)
                n = np.diff(bounds)
                keys = band_keys(densified(hashes, bounds)).view(np.int64)
                some = n > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(set_digests(hashes, bounds), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].reshape(-1)))],
                    names=["id", "n", "digest", "keys"],
                )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                part = batch.slice(a, z - a)
                hashes, bounds = shingle_sets(part.column(1), size)
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[8 * s : 8 * e] for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["id", "hashes"])

    return run


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b| for sorted sets."""
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return den * both >= num * (len(a) + len(b) - both)


def _verified(num: int, den: int):
    def run(batches):
        for batch in batches:
            left, right = (batch.column(k).to_pylist() for k in (2, 3))
            ok = [similar(np.frombuffer(x, _U), np.frombuffer(y, _U), num, den) for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _blocked(num: int, den: int):
    """Links between the queries and the held members of one block; a row may be both."""

    def run(table: pa.Table) -> pa.Table:
        ids, comps, query, held = (np.array(table.column(c).to_pylist()) for c in ("id", "component", "query", "held"))
        sets = [np.frombuffer(x, _U) for x in table.column("hashes").to_pylist()]
        rows = np.flatnonzero(held)
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate([np.zeros(0, _U), *(sets[r] for r in rows)])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        u, v = [], []
        for q in np.flatnonzero(query):
            lo, hi = np.searchsorted(flat, sets[q]), np.searchsorted(flat, sets[q], side="right")
            n = hi - lo
            hits = owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, int)
            both = np.bincount(hits, minlength=len(rows))
            ok = rows[(den * both >= num * (sizes[q] + sizes[rows] - both)) & (comps[rows] != comps[q])]
            ok = ok[np.unique(comps[ok], return_index=True)[1]]  # joining a component once is enough
            u += [int(ids[q])] * len(ok)
            v += ids[ok].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _salted(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on `key` where many rows of `left` may share one; `right` has a row a key and goes along SALTS times."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return left.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(right.select("*", salt), [key, "salt"], how).drop("salt")


def _star(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (key, id): the edges of each bucket's two-level star, and the members without the bucket's least id."""
    part = F.pmod(F.xxhash64("id"), F.lit(SPLIT)).cast("int").alias("part")
    dealt = members.select("key", part, "id")
    inner = dealt.groupBy("key", "part").agg(F.min("id").alias("centre"))
    centres = inner.groupBy("key").agg(F.min("centre").alias("u"))
    outer = inner.join(centres, "key").where("centre <> u").select("key", "u", F.col("centre").alias("v"))
    near = dealt.join(inner, ["key", "part"]).where("id <> centre").select("key", F.col("centre").alias("u"), F.col("id").alias("v"))
    arcs = cut(near.unionByName(outer))
    return arcs.select("u", "v").distinct(), arcs.select("key", F.col("v").alias("id"))


def _several(members: DataFrame, components: DataFrame) -> DataFrame:
    """(key, id, component) of buckets that hold several components."""
    named = cut(members.join(components.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return _salted(named, keys, "key", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Groups of documents linked by den * intersection >= num * union of their sets of `size`-word shingles.

    Returns (id_col, n_shingles, component_id, kept), one row per row of `docs`.
    Letters A-Z count as a-z; a text of fewer than `size` words is one shingle; a null or blank text
    has an empty set and is linked with nothing.  Rows that share an id are one document.  A row with a
    null id is linked with nothing: its component_id is null and it is kept.  Extra columns are ignored.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = cut(slim.mapInArrow(_signatures(size), "id long, n long, digest binary, keys array<long>"))
    full = marks.where("n > 0 and id is not null")
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = full.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("n").alias("n"))  # equal sets have equal keys
    rows = reps.select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    members = cut(rows.join(shared, "key", "left_semi"))

    wanted = members.select("id").distinct()
    texts = slim.join(reps.select("id").join(wanted.hint("shuffle_hash"), "id", "left_semi").hint("shuffle_hash"), "id", "left_semi")
    sets = cut(texts.mapInArrow(_sets(size), "id long, hashes binary").dropDuplicates())

    def verify(edges: DataFrame) -> DataFrame:
        pairs = edges.join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("hv")), "v").join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("hu")), "u")
        return pairs.select("u", "v", "hu", "hv").mapInArrow(_verified(num, den), "u long, v long")

    edges, rest = _star(members)
    links = cut(verify(edges))
    components = cut(connected_components(links))
    rest = cut(_several(rest, components))
    if not rest.isEmpty():
        components = cut(connected_components(links.unionByName(_in_blocks(rest, components, sets, num, den))))

    group = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = marks.join(group, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs`, all columns, with one document of each group of near-duplicates: the one of least id, once where its rows repeat it.

    Rows with a null id stay.  Of different texts under one kept id, all stay.
    """
    groups = near_duplicates(docs, id_col, text_col, size, num, den)
    gone, seen = free_name(docs, "gone_id"), free_name(docs, "text_hash")
    drop = groups.where("not kept").select(F.col(id_col).alias(gone)).distinct()
    kept = docs.join(drop.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(gone), "left_anti")
    again = groups.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).alias(gone))
    if again.isEmpty():
        return kept
    doubled = F.col(id_col).cast("long") == F.col(gone)
    once = kept.join(again, doubled, "left_semi").withColumn(seen, F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, seen]).drop(seen)
    return kept.join(again, doubled, "left_anti").unionByName(once)


def _in_blocks(rest: DataFrame, components: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components that share a bucket, in blocks of about BLOCK by BLOCK members, of less where sets are large.

    In each bucket one component has the most members.  The others' members are queries against all members of that
    component, once however many buckets they share, and against each other inside the bucket.
    """
    per = rest.groupBy("key", "component").agg(F.count("*").alias("n"))
    home = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("home"))
    size = sets.select("id", F.expr("octet_length(hashes) div 8").alias("size"))
    others = cut(_salted(rest, home, "key").where("component <> home").join(size, "id"))

    asked = others.select(F.col("home").alias("key"), "id", "component", "size").distinct()
    asking = _shape(asked, "m")
    named = components.select(F.col("component").alias("key"), F.col("node").alias("id"))
    alone = asking.select("key", F.col("key").alias("id"))  # a component of one is in no link
    held = _salted(named, asking.select("key"), "key", "left_semi").unionByName(alone).distinct().join(size, "id").select("key", "id", F.col("key").alias("component"), "size")
    shape = asking.join(_shape(held, "n"), "key")
    links = _compared(held, asked, shape, sets, num, den)

    several = others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    inside = _shape(others, "n").join(several, "key", "left_semi").withColumn("m", F.col("n"))
    return links.unionByName(_compared(others, others, inside, sets, num, den)).distinct()


def _shape(members: DataFrame, name: str) -> DataFrame:
    """Into how many blocks each key's members go."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    return members.groupBy("key").agg(blocks.alias(name))


def _compared(members: DataFrame, queries: DataFrame, shape: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between queries and members of a key (n blocks of members, m of queries), every block of queries with every block of members."""
    shape = shape.select("key", "n", "m")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    alone = F.col("n") + F.col("m") == 2 if queries is members else F.lit(False)  # a row goes once where its block meets itself
    data = _salted(members, shape, "key").select("key", "id", "component", own("n").alias("b"), blocks("m").alias("q"), alone.alias("query"), F.lit(True).alias("held"))
    asking = _salted(queries, shape, "key").where(~alone).select("key", "id", "component", blocks("n").alias("b"), own("m").alias("q"), F.lit(True).alias("query"), F.lit(False).alias("held"))
    return data.unionByName(asking).join(sets, "id").groupBy("key", "b", "q").applyInArrow(_blocked(num, den), "u long, v long")
