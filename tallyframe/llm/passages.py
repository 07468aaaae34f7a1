"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last 16 bytes is least among the RADIUS
positions on either side (the first of equal ones), so boundaries depend on near-by bytes only and an
insertion shifts none beyond it.  Where no boundary comes for MOST bytes, as in a run of one character, the
text is cut every MOST bytes after the last one.  Chunks average about 2 * RADIUS bytes and are
deduplicated by a digest of 128 bits: the document with the least id owns a chunk, all others
repeat it.  A digest that has more than one in HOT_SHARE of all chunk rows is looked up where the chunk is read: there are
fewer than HOT_SHARE such digests, so their table is broadcast; all others meet their owners in a join.  Consecutive repeated chunks form a span, and spans of MIN_WORDS
words or more (MIN_BYTES where words are long) are repeated passages.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .spark_io import cut, free_name
from .vectext import IS_SPACE, range_hashes, slices_of

RADIUS = 16
MOST = 1024
HOT_SHARE = 10_000
MIN_WORDS, MIN_BYTES = 25, 400
PAD = 0xFF  # never occurs in UTF-8
_U = np.uint64
_TOP = _U(2**64 - 1)
_GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GEAR[PAD] = 0
_SLICE = 1 << 20
_OTHER = np.random.Generator(np.random.PCG64(5)).permutation(256).astype(np.uint8)  # bytes in another order, for a second digest


def _ends(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends by content, for bytes in which texts are apart by pads of RADIUS + 16 bytes."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << _U(step))  # numpy evaluates the right side first
    h[data == PAD] = _TOP
    h[:-1][(data[1:] & 0xC0) == 0x80] = _TOP  # no end inside a character
    if len(h) <= 2 * RADIUS:
        return np.zeros(0, np.int64)
    least, width = h, 1  # least[i]: of h[i : i + width]
    while width * 2 <= RADIUS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < RADIUS:
        rest = RADIUS - width
        least = np.minimum(least[:-rest], least[rest:])
    centre = h[RADIUS:-RADIUS]
    return np.flatnonzero((centre < least[: len(centre)]) & (centre <= least[RADIUS + 1 : RADIUS + 1 + len(centre)]) & (centre != _TOP)) + RADIUS


def _cut_long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Further ends inside chunks of more than MOST bytes, each moved on to the end of its character."""
    n = np.maximum((ends - starts - 1) // MOST, 0)
    long = np.repeat(np.arange(len(starts)), n)
    at = starts[long] + MOST * (np.arange(len(long)) - np.repeat(np.cumsum(n) - n, n) + 1)
    for _ in range(3):
        at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    return at[at < ends[long]]


def _starts(ends: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of each chunk from the sorted ends."""
    text = np.searchsorted(begin, ends - 1, side="right") - 1
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    first = np.ones(len(ends), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    starts[first] = begin[text[first]]
    return text, starts


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, digest, words) of every chunk of every text, as `_chunked` without the second half of the digest."""
    text, start, end, digest, _, words = _chunked(texts)
    return text, start, end, digest, words


def _chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, digest, its second half, words) of every chunk of every text; starts and ends are byte offsets in the text."""
    gap = bytes([PAD]) * (RADIUS + 16)
    data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = len(gap) + np.concatenate([[0], np.cumsum(sizes + len(gap))[:-1]]).astype(np.int64)
    cuts, margin = [], RADIUS + 16
    for k in range(0, len(data), _SLICE):  # windows of a slice reach into its neighbours
        lo, hi = max(0, k - margin), min(len(data), k + _SLICE + margin)
        found = _ends(data[lo:hi]) + lo
        cuts.append(found[(found >= k) & (found < k + _SLICE)])
    some = sizes > 0
    ends = np.unique(np.concatenate([*cuts, (begin + sizes - 1)[some]])) + 1
    text, starts = _starts(ends, begin)
    more = _cut_long(data, starts, ends)
    if len(more):
        ends = np.sort(np.concatenate([ends, more]))
        text, starts = _starts(ends, begin)
    second = range_hashes(data, starts, ends, _OTHER)
    digest = range_hashes(data, starts, ends)
    blank = IS_SPACE[data] | (data == PAD)
    heads = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    words = np.searchsorted(heads, ends) - np.searchsorted(heads, starts)
    return text, starts - begin[text], ends - begin[text], digest, second, words


def _byte_texts(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _digests(batches):
    for batch in batches:
        for a, z in slices_of(batch.column(1)):
            part = batch.slice(a, z - a)
            text, _, _, digest, second, _ = _chunked(_byte_texts(part.column(1)))
            order = np.lexsort((digest, text))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (digest[order][1:] != digest[order][:-1]) | (text[order][1:] != text[order][:-1])
            keep = order[new]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[keep])), pa.array(digest[keep].view(np.int64)), pa.array(second[keep].view(np.int64))], names=["id", "digest", "second"])


def _chunks(batches):
    for batch in batches:
        for a, z in slices_of(batch.column(1)):
            part = batch.slice(a, z - a)
            text, start, end, digest, second, words = _chunked(_byte_texts(part.column(1)))
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(2).take(at), pa.array(start), pa.array(end), pa.array(digest.view(np.int64)), pa.array(second.view(np.int64)), pa.array(words.astype(np.int32))],
                names=["id", "version", "start", "end", "digest", "second", "words"],
            )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, span_start, span_end, n_words, first_doc_id, version): byte spans of a document whose chunks all occur in documents of lesser id.

    first_doc_id is the least owner among the span's chunks.  The owner's own copy is in no span.  `version` tells apart
    different texts under one id; rows that share an id are one document, so they repeat nothing of each other.
    Of chunks with equal digests, rows that repeat each other included, only the least id counts as the owner.  Passages
    that only one document holds, however often, are not looked for.
    Rows with a null id, null and empty texts have no spans; extra columns are ignored.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    key = ["digest", "second"]
    counted = slim.mapInArrow(_digests, "id long, digest long, second long").groupBy(*key).agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count("*").alias("n"))
    owners = cut(counted.where("owner < last").select(*key, "owner", "n"))
    total = owners.agg(F.sum("n")).first()[0] or 0
    hot = owners.where(F.col("n") * HOT_SHARE > total).select(*key, F.col("owner").alias("hot_owner"))  # fewer than HOT_SHARE rows
    chunks = slim.select("id", "text", F.xxhash64("text").alias("version")).mapInArrow(_chunks, "id long, version long, start long, end long, digest long, second long, words int")
    known = chunks.join(F.broadcast(hot), key, "left")
    place = ["id", "version", "start", "end"]
    cold = F.col("hot_owner").isNull()
    # a chunk whose owner is known goes along under a key of its own and without a second digest, so that it meets no one
    known = known.withColumn("digest", F.when(cold, F.col("digest")).otherwise(F.xxhash64(*place))).withColumn("second", F.when(cold, F.col("second")))
    met = known.join(owners.where(F.col("n") * HOT_SHARE <= total).select(*key, "owner"), key, "left").withColumn("owner", F.coalesce("hot_owner", "owner"))
    repeats = met.where("owner < id").groupBy(*place).agg(F.min("owner").alias("owner"), F.max("words").alias("words"))
    return _spans(repeats, min_words, min_bytes)


def _spans(repeats: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    """Join consecutive chunks; a chunk starts a span unless another one ends where it starts."""
    place = Window.partitionBy("id", "version").orderBy("start")
    marked = repeats.withColumn("new", F.coalesce(F.col("start") != F.lag("end").over(place), F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "version", "run").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.sum("words").alias("n_words"), F.min("owner").alias("first_doc_id"))
    kept = spans.where((F.col("n_words") >= min_words) | (F.col("span_end") - F.col("span_start") >= min_bytes))
    return kept.select(F.col("id").alias("doc_id"), "span_start", "span_end", "n_words", "first_doc_id", "version")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """`docs`, all columns, with repeated passages cut from the texts; a text that becomes blank by that goes.

    A cut leaves the characters around it as they are.  Texts without spans stay as they are, null and empty ones too.
    """
    spans = repeated_passages(docs, id_col, text_col, min_words, min_bytes)
    cuts_col, id_, version = (free_name(docs, n) for n in ("cuts", "cut_id", "cut_version"))
    cuts = spans.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias(cuts_col))
    cuts = cuts.withColumnsRenamed({"doc_id": id_, "version": version})
    joined = docs.join(cuts.hint("shuffle_hash"), (F.col(id_col).cast("long") == F.col(id_)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(version)), "left")
    raw = F.encode(F.col(text_col).cast("string"), "UTF-8")
    ends = F.concat(F.transform(cuts_col, lambda c: c["span_start"]), F.array(F.octet_length(raw).cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts_col, lambda c: c["span_end"]))
    pieces = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: raw.substr((p["s"] + 1).cast("int"), (p["e"] - p["s"]).cast("int")))
    whole = F.aggregate(pieces, F.lit(b""), lambda acc, x: F.concat(acc, x))
    text = F.when(F.col(cuts_col).isNull(), F.col(text_col)).otherwise(F.decode(whole, "UTF-8"))
    fresh = free_name(docs, "cut_text")
    out = joined.withColumn(fresh, text).where(F.col(cuts_col).isNull() | (F.trim(F.regexp_replace(fresh, r"[\x09-\x0D]", " ")) != ""))
    return out.select(*[F.col(fresh).alias(c) if c == text_col else F.col(c) for c in docs.columns])
