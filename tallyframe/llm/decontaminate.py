"""Benchmark decontamination: rare word n-gram seeds, then Smith-Waterman alignment on words.

Pass 1 counts, over all documents, in how many each benchmark n-gram occurs.
An n-gram is SEED_WORDS words, or a whole item that has fewer.
An item's n-grams are seeds unless they are common beside its others, which
tells phrases of the language apart from the item's own words however often
the item was copied; a few unedited words anywhere are enough.  Pass 2 finds the seeds in every document and aligns
the words around them with the item.  Both passes are Arrow map stages without
a shuffle of texts; the benchmark goes to the executors in slices of at most
`slice_bytes`, so what is sent at once is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .vectext import IS_SPACE_OR_MARK, buffers, mix, scan_words, shingle_hashes, slices_of

SEED_WORDS, WINDOW, COMMON = 3, 4, 8
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 20
CELLS = 1 << 20  # alignment cells of a row that are held together
_U = np.uint64
HIT_SCHEMA = "doc_id long, item_id long, n_matched int, n_item_words int, identity double, score int, span_start long, span_end long"


def _grams(scanned, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in its text of every run of each number of words."""
    out = []
    for size in sizes:
        grams, text = shingle_hashes(scanned, size)
        long = np.diff(scanned.bounds)[text] >= size
        grams, text = grams[long], text[long]
        out.append((mix(grams + _U(size)), text, np.arange(len(grams)) - np.searchsorted(text, np.arange(len(scanned.bounds)))[text]))
    return tuple(np.concatenate(c) for c in zip(*out))


@dataclass
class Items:
    """Benchmark items of one slice: word hashes and sorted n-gram postings."""

    ids: list
    words: list
    sizes: tuple  # numbers of words that n-grams have
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list, keep: np.ndarray | None = None) -> Items:
        scanned = scan_words(pa.array(texts, pa.string()), breaks=IS_SPACE_OR_MARK)
        words = [scanned.hashes[a:z] for a, z in zip(scanned.bounds[:-1], scanned.bounds[1:])]
        own = np.minimum(np.diff(scanned.bounds), SEED_WORDS)
        sizes = tuple(int(n) for n in np.unique(own[own > 0])) or (SEED_WORDS,)
        parts = []
        for size in sizes:
            grams, item, place = _grams(scanned, (size,))
            parts.append([c[own[item] == size] for c in (grams, item, place)])
        grams, item, place = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((place, item))
        grams, item, place = grams[order], item[order], place[order]
        if keep is not None:
            grams, item, place = grams[keep], item[keep], place[keep]
        order = np.argsort(grams, kind="stable")
        sieve = np.zeros(1 << FILTER_BITS, dtype=bool)
        sieve[(grams & _U((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return cls(ids, words, sizes, grams[order], item[order], place[order], sieve)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `grams` that hold an n-gram of the items, and the first posting of each."""
        near = np.flatnonzero(self.sieve[(grams & _U((1 << FILTER_BITS) - 1)).astype(np.int64)])
        if not len(near) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.grams, grams[near])
        at[at == len(self.grams)] = 0
        ok = self.grams[at] == grams[near]
        return near[ok], at[ok]


def seed_grams(counts: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which n-grams (in item order) are seeds.

    Of the n-grams of an item that occur in documents at all, all but the common ones are: those of more than COMMON times
    the median count.  Where WINDOW consecutive ones are common, the rarest of them (all on ties) is a seed too.
    """
    keep = np.zeros(len(counts), dtype=bool)
    rows = np.flatnonzero(counts > 0)
    if not len(rows):
        return keep
    own, of = counts[rows], item[rows]
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[begin, len(of)])
    ranked = own[np.lexsort((own, of))]
    median = (ranked[begin + (size - 1) // 2] + ranked[begin + size // 2]) / 2
    good = own <= COMMON * np.repeat(median, size)
    first, last = np.repeat(begin, size), np.repeat(begin + size, size)
    at = np.arange(len(of))
    span = np.minimum(WINDOW, last - first)
    starts = at[at + span <= last]  # windows that lie in their item
    upto = np.r_[0, np.cumsum(good)]
    bad = starts[upto[starts + span[starts]] == upto[starts]]
    for j in range(WINDOW):
        inside = bad[j < span[bad]]
        least = np.minimum.reduce([own[np.minimum(inside + k, inside + span[inside] - 1)] for k in range(WINDOW)]) if len(inside) else own[:0]
        good[inside[own[inside + j] == least] + j] = True
    keep[rows] = good
    return keep


_FIELD = 21  # bits of a cell's place and of its matched words
_PLACES = (1 << _FIELD) - 1


def align(item: np.ndarray, windows: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Smith-Waterman of one item with each window: score, matched words, first and last aligned word of the window.

    Rows run over the item's words; all windows advance together, and only the present row is held.  A cell is one integer of its score,
    the matched words on its path, and where that path begins (turned, so that of equal paths the shorter one is greater), so that the greatest
    cell has the whole answer and no way back is needed.  A gap along a window is resolved with a running maximum, which is exact for a linear gap cost.
    """
    width = max(map(len, windows))
    n = len(windows)
    words = np.zeros((n, width), dtype=np.uint64)
    real = np.zeros((n, width), dtype=bool)
    for k, w in enumerate(windows):
        words[k, : len(w)] = w
        real[k, : len(w)] = True
    one = 1 << 2 * _FIELD
    fresh = _PLACES - np.arange(width + 1, dtype=np.int64)  # a path that begins after this word
    ramp = -GAP * one * np.arange(width + 1, dtype=np.int64)
    row = np.tile(fresh, (n, 1))
    best, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    lane = np.arange(n)
    for word in item:
        same = (words == word) & real
        new = row + GAP * one
        np.maximum(new[:, 1:], row[:, :-1] + np.where(same, MATCH * one + (1 << _FIELD), MISMATCH * one), out=new[:, 1:])
        np.maximum(new, fresh, out=new)
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        np.maximum(row, fresh, out=row)
        at = np.argmax(row, axis=1)
        top = row[lane, at]
        more = top > best
        best[more], last[more] = top[more], at[more] - 1
    score, matched, first = best >> 2 * _FIELD, best >> _FIELD & _PLACES, _PLACES - (best & _PLACES)
    return [(int(s), int(m), int(a), int(z)) if s else (0, 0, 0, -1) for s, m, a, z in zip(score, matched, first, last)]


def leaks_in(column, items: Items, min_matched: int, min_share: float, min_identity: float) -> list[tuple]:
    """(row, item index, matched, identity, score, byte start, byte end) of each item found in each text, best alignment only."""
    scanned = scan_words(column, breaks=IS_SPACE_OR_MARK)
    grams, text, place = _grams(scanned, items.sizes)
    at, posting = items.find(grams)
    if not len(at):
        return []
    size = np.searchsorted(items.grams, items.grams[posting], side="right") - posting
    rep = np.repeat(np.arange(len(at)), size)
    post = np.repeat(posting, size) + np.arange(len(rep)) - np.repeat(np.cumsum(size) - size, size)
    row, item = text[at][rep], items.item[post]
    start = place[at][rep] - items.place[post]  # word of the text where the item would begin
    order = np.lexsort((start, row, item))
    row, item, start = row[order], item[order], start[order]
    starts0, offsets = scanned.bounds, buffers(column)[1]
    found: dict[tuple[int, int], tuple] = {}
    edges = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True])
    for a, z in zip(edges, edges[1:]):
        i, sel = item[a], slice(a, z)
        m = len(items.words[i])
        slack = m // 2 + 4
        new = np.ones(z - a, dtype=bool)
        new[1:] = (row[sel][1:] != row[sel][:-1]) | (start[sel][1:] - start[sel][:-1] > slack)
        group = np.flatnonzero(new)
        ends = np.append(group[1:], z - a) - 1
        todo = []
        for g, e in zip(a + group, a + ends):
            r = int(row[g])
            lo = max(0, int(start[g]) - slack)
            hi = min(int(starts0[r + 1] - starts0[r]), int(start[e]) + m + slack)
            todo.append((r, lo, hi))
        todo.sort(key=lambda t: t[2] - t[1])
        need = max(min(SEED_WORDS, m), min(min_matched, int(np.ceil(min_share * m))))
        while todo:  # as many windows together as CELLS allow, one at least
            n = 1
            while n < len(todo) and (n + 1) * (todo[n][2] - todo[n][1] + 1) <= CELLS:
                n += 1
            part, todo = todo[:n], todo[n:]
            for (r, lo, _), (score, matched, b, e) in zip(part, align(items.words[i], [scanned.hashes[starts0[r] + lo : starts0[r] + hi] for r, lo, hi in part])):
                identity = matched / max(1, e - b + 1)
                if matched >= need and identity >= min_identity and score > found.get((r, int(i)), (0, 0.0, -1, 0, 0))[2]:
                    w = starts0[r] + lo
                    found[(r, int(i))] = (matched, identity, score, int(scanned.starts[w + b] - offsets[r]), int(scanned.ends[w + e] - offsets[r]))
    return [(r, i, *v) for (r, i), v in found.items()]


def _count(items: Items):
    def run(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for a, z in slices_of(batch.column(0)):
                column = batch.column(0).slice(a, z - a)
                grams, text, _ = _grams(scan_words(column, breaks=IS_SPACE_OR_MARK), items.sizes)
                at, posting = items.find(grams)
                pairs = np.unique(np.stack([text[at], posting], axis=1), axis=0) if len(at) else np.zeros((0, 2), int)
                for gram, n in zip(*np.unique(pairs[:, 1], return_counts=True)):
                    total[int(gram)] = total.get(int(gram), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return run


class BenchmarkSeeds:
    """Items of one slice with their seeds chosen; small enough to go with each task."""

    def __init__(self, docs: DataFrame, text_col: str, rows: list):
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        every = Items.of(ids, texts)
        counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_count(every), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(every.grams), dtype=np.int64)
        for gram, n in counted.collect():  # at most one row for each n-gram of the slice
            counts[np.searchsorted(every.grams, every.grams[gram]) : np.searchsorted(every.grams, every.grams[gram], side="right")] = n
        back = np.lexsort((every.place, every.item))
        self.items = Items.of(ids, texts, seed_grams(counts[back], every.item[back]))


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int):
    """Lists of (item id, text) of at most `slice_bytes` (one item at least), streamed; null and wordless items have no seeds."""
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).toLocalIterator():
        if rows and size + len(r[1]) > slice_bytes:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1])
    if rows:
        yield rows


def _hits(items: Items, *limits):
    def run(batches):
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                part = batch.slice(a, z - a)
                ids = part.column(0)
                found = leaks_in(part.column(1), items, *limits)
                cols = list(zip(*found)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(cols[0], pa.int64())),
                        pa.array([items.ids[i] for i in cols[1]], pa.int64()),
                        pa.array(cols[2], pa.int32()),
                        pa.array([len(items.words[i]) for i in cols[1]], pa.int32()),
                        pa.array(cols[3], pa.float64()),
                        pa.array(cols[4], pa.int32()),
                        pa.array(cols[5], pa.int64()),
                        pa.array(cols[6], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "n_matched", "n_item_words", "identity", "score", "span_start", "span_end"],
                )

    return run


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_matched: int = 10, min_share: float = 0.6, min_identity: float = 0.5, slice_bytes: int = 16 << 20) -> DataFrame:
    """One row per document row and benchmark item that it contains a copy or edited copy of, with the best alignment.

    An item is contained if an alignment matches at least min(min_matched, min_share of the item) of its words
    and `min_identity` of the words it spans.  Words are runs without white space and ASCII punctuation; A-Z count
    as a-z.  A copy is looked at where SEED_WORDS consecutive words of the item stand in it, or the whole item if it is
    shorter: an item of one or two words is contained in every text that holds these words.
    span_start and span_end are byte offsets into the text.  Null or blank texts and items never match;
    null ids are carried as null; repeated rows give repeated results; an empty side gives no rows; extra columns are ignored.
    """
    ship(docs.sparkSession)
    out = None
    for rows in benchmark_slices(benchmark, item_id, item_text, slice_bytes):
        items = BenchmarkSeeds(docs, text_col, rows).items
        part = docs.select(F.col(doc_id).cast("long"), F.col(text_col).cast("string")).mapInArrow(_hits(items, min_matched, min_share, min_identity), HIT_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], HIT_SCHEMA) if out is None else out


def _without(items: Items, position: int, *limits):
    def run(batches):
        for batch in batches:
            for a, z in slices_of(batch.column(position)):
                part = batch.slice(a, z - a)
                bad = {f[0] for f in leaks_in(part.column(position), items, *limits)}
                yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_()))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_matched: int = 10, min_share: float = 0.6, min_identity: float = 0.5, slice_bytes: int = 16 << 20) -> DataFrame:
    """`docs`, all columns, without the rows in which `benchmark_leaks` finds an item."""
    ship(docs.sparkSession)
    for rows in benchmark_slices(benchmark, item_id, item_text, slice_bytes):
        items = BenchmarkSeeds(docs, text_col, rows).items
        docs = docs.mapInArrow(_without(items, docs.columns.index(text_col), min_matched, min_share, min_identity), docs.schema)
    return docs
