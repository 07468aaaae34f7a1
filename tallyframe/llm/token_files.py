"""Token-id files: whole texts to ids, ids to range-coded blocks, and back.

Documents are range-partitioned by id and sorted, so the files hold them in ascending order.  A
task is one shard: it streams texts through the tokenizer, cuts the ids into blocks of BLOCK ids
whatever documents they belong to, and codes LANES blocks together.  A row of the file
table is a block: its shard and number, how many ids of the shard come before it, the id count, the CRC-32,
the payload, the documents that begin in it with their lengths, where the first of them starts, and where the
document that is open at the block's start began.  Spark's writer commits the files, so a task that is run again leaves no half block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .range_coder import BLOCK, LANES, MAX_ID, checked, decode_blocks, encode_blocks, id_bytes, joined_crc
from .vectext import IS_SPACE, buffers, slices_of

END_ID = 0
MEMO_WORDS, SLICE_BYTES = 2_000_000, 8 << 20  # known words of a task, bytes of text coded together
JOINED = 256  # words in a text for the library
FILE_SCHEMA = "shard int, block int, base long, n_ids int, crc32 long, payload binary, open_start long, first_start long, doc_ids array<long>, doc_lens array<long>"
_FRAGMENTS = "shard int, start_in_shard long, doc_id long, begins boolean, pos long, n long, crc long"
_DIGIT = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_DIGIT, -1, 1 << 64)
_tokenizers: dict = {}
_coders: dict = {}


def load_tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each byte position is white space; one whose last bytes are like those of a white space outside ASCII is taken for one."""
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (one <= 0x20) | (one == 0x7F) | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))


def _word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where texts are cut into words for the tokenizer: where white space follows another character.

    No token spans such a place and none depends on what stands before it, so that the ids of a text are those of its words.
    """
    at = np.flatnonzero(IS_SPACE[data])
    cuts = np.sort(np.concatenate([offsets, at[~_ends_in_space(data, at)]]), kind="stable")
    return cuts[np.append(True, cuts[1:] != cuts[:-1])]


def _digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A number of 64 bits of each word: its bytes as digits, modulo 2**64, from the differences of sums over all words."""
    first, last = int(offsets[0]), int(offsets[-1])
    powers, inverse = np.full(last - first + 1, _DIGIT, dtype=np.uint64), np.full(last - first + 1, _INVERSE, dtype=np.uint64)
    powers[0] = inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    powers[1:] = (data[first:last] + np.uint64(1)) * powers[:-1]
    powers[0] = 0
    np.cumsum(powers, out=powers)
    at = np.asarray(offsets) - first
    return (powers[at[1:]] - powers[at[:-1]]) * inverse[at[:-1]]


class WordCoder:
    """Ids of whole texts by the library, each distinct word once; the table of known words starts anew when it is full."""

    def __init__(self, path: str):
        tokenizer = load_tokenizer(path)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        vocabulary = tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each id
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # a byte-level token has a character a byte
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.array([END_ID], dtype=np.uint16)
        self.ends = np.array([1])  # of the words' ids; the end id is word 0
        self.digests, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of known words, in order of the digest

    def _learn(self, words: pa.LargeStringArray) -> np.ndarray:
        """Where each new word stands behind the known ones.  Code them: those that start with white space and end with none many in a text, whose ids are cut at the words' lengths, others alone."""
        data, offsets = buffers(words)
        joins = IS_SPACE[data[offsets[:-1]]] & ~_ends_in_space(data, offsets[1:])
        first, other = words.filter(pa.array(joins)), words.filter(pa.array(~joins))
        raw, bounds = buffers(first)
        raw, pieces = raw.tobytes(), [*bounds[:-1:JOINED].tolist(), int(bounds[-1])]
        ids = self._coded([raw[a:z].decode() for a, z in zip(pieces, pieces[1:])])
        ids = np.concatenate([np.zeros(0, np.uint16), *ids])
        upto = np.cumsum(self.length[ids])
        ends = np.searchsorted(upto, bounds[1:]) + 1
        if len(ids) != (ends[-1] if len(ends) else 0) or (upto[ends - 1] != bounds[1:]).any():
            raise ValueError("the tokenizer's ids don't end where words do")
        alone = self._coded(other.to_pylist())
        self.known = pa.concat_arrays([self.known, first, other])
        self.ends = np.concatenate([self.ends, len(self.ids) + ends, len(self.ids) + len(ids) + np.cumsum([len(x) for x in alone], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids, *alone])
        place = np.empty(len(words), dtype=np.int64)
        place[np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])] = np.arange(len(words))
        return place

    def _numbers(self, words: pa.LargeStringArray) -> np.ndarray:
        """Number of each distinct word among the known ones; new ones are learnt.  Words are looked up by digest, then compared as they are."""
        digests = _digests(*buffers(words))
        order = np.argsort(digests)
        at = np.empty(len(words), dtype=np.int64)
        at[order] = np.searchsorted(self.digests, digests[order])
        hit = np.flatnonzero(np.append(self.digests, np.uint64(0))[at] == digests) if len(self.digests) else np.zeros(0, np.int64)
        hit = hit[at[hit] < len(self.digests)]
        number = np.full(len(words), -1)
        number[hit] = self.numbers[at[hit]]
        if not pc.all(pc.equal(words.take(pa.array(hit)), self.known.take(pa.array(number[hit])))).as_py() and len(hit):  # two words have one digest
            number = pc.index_in(words, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            before = len(self.known)
            number[new] = before + self._learn(words.take(pa.array(new)))
            fresh = new[np.argsort(digests[new])]
            at = np.searchsorted(self.digests, digests[fresh])
            self.digests, self.numbers = np.insert(self.digests, at, digests[fresh]), np.insert(self.numbers, at, number[fresh])
        return number

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(texts), 64):
            out += [np.array(coded.ids, dtype=np.uint16) for coded in self.encode(texts[a : a + 64], add_special_tokens=False)]
        return out

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, the end id after each, and each one's count with the end id."""
        data, offsets = buffers(column)
        cuts = _word_cuts(data, offsets)
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        if len(self.known) > MEMO_WORDS:
            self._empty()
        at = self._numbers(words.dictionary) + 1
        upto = np.searchsorted(cuts, offsets[1:])  # words of the texts up to each one's end
        which = np.insert(at[words.indices.to_numpy()], upto, 0)
        end = self.ends[which]
        n = end - np.concatenate([[0], self.ends])[which]
        total = np.cumsum(n)
        ids = self.ids[np.repeat(end - total, n) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.diff(total[upto + np.arange(len(upto))], prepend=0)


def word_coder(path: str) -> WordCoder:
    """The coder of this worker process, so that tasks after the first one know its words."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def _write(path: str):
    def run(batches):
        coder = word_coder(path)
        shard = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        starts: list[tuple[int, int | None, int]] = []  # (start in shard, id, length) of documents whose start isn't written yet
        size = base = block = total = 0
        open_start = -1

        def blocks(ids: np.ndarray):
            nonlocal base, block, starts, open_start
            parts = [ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK)]
            rows = []
            for part, payload in zip(parts, encode_blocks(parts)):
                here = [s for s in starts if s[0] < base + len(part)]
                starts = starts[len(here) :]
                rows.append((shard, block, base, len(part), zlib.crc32(id_bytes(part)), payload, open_start, here[0][0] if here else -1, [s[1] for s in here], [s[2] for s in here]))
                for s in here:
                    open_start = s[0]
                base, block = base + len(part), block + 1
                if open_start >= 0 and here and here[-1][0] + here[-1][2] == base:
                    open_start = -1
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            for k in range(0, len(rows), 256):
                columns = zip(*rows[k : k + 256])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[n.split()[0] for n in FILE_SCHEMA.split(", ")])

        for batch in batches:
            for a, z in slices_of(batch.column(1), SLICE_BYTES):
                part = batch.slice(a, z - a)
                ids, counts = coder.texts(part.column(1))
                for doc, n in zip(part.column(0).to_pylist(), counts.tolist()):
                    starts.append((total, doc, n))
                    total += n
                held.append(ids)
                size += len(ids)
                if size >= BLOCK * LANES:
                    flat = np.concatenate(held)
                    whole = len(flat) // BLOCK * BLOCK
                    yield from blocks(flat[:whole])
                    held, size = [flat[whole:]], len(flat) - whole
        if size:
            yield from blocks(np.concatenate(held))

    return run


def write_token_files(docs: DataFrame, out_path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Write the files.  Ids ascend, a null id comes first; rows of one id go by text.  A null text is empty: it has the end id alone.

    Texts of any length are coded whole; their ids run on over as many blocks as they need.  An empty table gives files without blocks.
    Ids take 16 bits: a tokenizer with ids over MAX_ID is refused before anything is written.
    """
    spark = docs.sparkSession
    ship(spark)
    largest = max(load_tokenizer(tokenizer_path).get_vocab().values(), default=0)
    if largest > MAX_ID:
        raise ValueError(f"the tokenizer has ids up to {largest}; the files hold ids up to {MAX_ID}")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    placed = slim.repartitionByRange(shards, F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    placed.mapInArrow(_write(tokenizer_path), FILE_SCHEMA).write.parquet(out_path)


def _fragments(batches):
    names = [n.split()[0] for n in _FRAGMENTS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for a in range(0, batch.num_rows, LANES):
            rows = batch.slice(a, LANES).to_pylist()
            out = []
            for r, ids in zip(rows, decode_blocks([r["payload"] for r in rows], [r["n_ids"] for r in rows])):
                raw = memoryview(id_bytes(checked(ids, r["crc32"])))
                begin = [(r["base"], r["open_start"], None, False)] if r["open_start"] >= 0 else []
                end, at = r["base"] + r["n_ids"], r["first_start"]
                for doc, n in zip(r["doc_ids"], r["doc_lens"]):
                    begin.append((at, at, doc, True))
                    at += n
                stops = [b[0] for b in begin[1:]] + [end]
                for (pos, start, doc, new), stop in zip(begin, stops):
                    piece = raw[4 * (pos - r["base"]) : 4 * (stop - r["base"])]
                    out.append((r["shard"], start, doc, new, pos, stop - pos, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files; a block whose ids don't match its checksum is an error.

    start counts the ids of all documents before it, in ascending order over all shards.
    """
    ship(spark)
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = sorted((r.shard, r.n) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a row a shard
    offsets, before = [], 0
    for shard, n in totals:
        offsets.append((shard, before))
        before += n
    decoded = files.mapInArrow(_fragments, _FRAGMENTS)
    whole = decoded.groupBy("shard", "start_in_shard").agg(F.max("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))

    @F.pandas_udf("long")
    def crc_of(parts):
        def one(fragments):
            total = int(fragments[0]["crc"])
            for f in fragments[1:]:
                total = joined_crc(total, int(f["crc"]), 4 * int(f["n"]))
            return total

        return parts.map(one)

    placed = whole.join(F.broadcast(spark.createDataFrame(offsets, "shard int, offset long")), "shard")
    return placed.select("doc_id", (F.col("offset") + F.col("start_in_shard")).alias("start"), "n_tokens", crc_of("parts").alias("ids_crc32"))
