"""Toxicity: a support vector machine on a gapped subsequence string kernel, with Nyström landmarks.

The kernel compares two words by their common subsequences of three letters that span at most five, each
weighted DECAY to the power of its span, and is normalised.  Letters are folded, digits that stand for letters are
read as these, marks inside a word are dropped, and runs of single letters are read as a word, so an insult with
gaps or inserted characters still shares most of its subsequences with the plain one.  A letter is a folded byte: the bytes of
other scripts share 27 codes, which keeps their words apart by order and length but not without fail.  Words of more than WINDOW letters are
read in overlapping windows, in training and in scoring alike.

A sentence is as toxic as its most toxic word.  Only whole documents are labelled, so training alternates
between picking each toxic document's most toxic word (and all words that toxic documents alone have too often for chance)
and fitting the machine on these against all words of clean documents (hardest ones added by rounds).  Nyström features are linear in kernel values with the landmarks,
so the fitted machine folds into one weight a subsequence: scoring reads a table of 64^3 numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .spark_io import bounded_sample
from .vectext import IS_SPACE, Words, buffers, range_hashes, slices_of, word_ranges

DECAY = 0.7
PLACES = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
WINDOW = 32  # letters of a word looked at together; longer words are read in overlapping windows
TRAIN_DOCS, TRAIN_CHARS, TRAIN_TOTAL = 3000, 20_000, 8_000_000  # labelled documents of a class, the longest text, and characters of a class, that training takes
LANDMARKS, POOL, ROUNDS = 256, 12_000, 3
THRESHOLD = 0.3

_WEIGHTS = np.array([DECAY ** (b + 1) for _, b in PLACES], dtype=np.float32)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
for _digit, _letter in zip(b"013457@", b"oieasta"):
    _FOLD[_digit] = _letter
_KEEP = np.array([IS_SPACE[b] or chr(_FOLD[b]).isalnum() or b >= 0x80 for b in range(256)])
#: Letters a-z, digits, then the bytes of other characters; 0 is no letter.
_CODE = np.array([b - 0x60 if 0x61 <= b <= 0x7A else 27 + (b - 0x30) if 0x30 <= b <= 0x39 else 37 + b % 27 if b >= 0x80 else 0 for b in range(256)], dtype=np.int32)


def letters(column) -> tuple[np.ndarray, Words]:
    """Folded letters of all texts, and their words; each run of three or more single letters is a further word at the end of `Words`' range arrays."""
    data, offsets = buffers(column)
    keep = _KEEP[data]
    at = np.concatenate([[0], np.cumsum(keep)])
    data, offsets = _FOLD[data[keep]], at[offsets]
    starts, ends = word_ranges(data, offsets)
    return data, Words(range_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))


def _spelled(data: np.ndarray, words: Words) -> list[tuple[int, bytes]]:
    """(text, letters) of the runs of three or more single-letter words."""
    single = (words.ends - words.starts == 1).astype(np.int8)
    if not single.any():
        return []
    text = words.text_of()
    edge = np.diff(np.concatenate([[0], single, [0]]))
    out = []
    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        while a < z:
            stop = min(z, int(words.bounds[text[a] + 1]))
            if stop - a >= 3:
                out.append((int(text[a]), data[words.starts[a:stop]].tobytes()))
            a = stop
    return out


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of given sizes: the word and the offset of each window."""
    n = np.maximum(1, -(-(sizes - WINDOW // 2) // (WINDOW // 2)))
    word = np.repeat(np.arange(len(sizes)), n)
    return word, (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW // 2)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, WINDOW) letter codes to ids (0: none) and normalised weights of all subsequences, (rows, k)."""
    n, width = codes.shape
    padded = np.zeros((n, width + 4), dtype=np.int32)
    padded[:, :width] = codes
    parts = []
    for k, (a, b) in enumerate(PLACES):
        first, mid, last = padded[:, :width], padded[:, a : a + width], padded[:, b : b + width]
        parts.append(np.where((first > 0) & (mid > 0) & (last > 0), ((first << 12) | (mid << 6) | last) << 3 | k, 0))
    packed = np.sort(np.concatenate(parts, axis=1), axis=1)
    ids, weights = packed >> 3, np.where(packed > 0, _WEIGHTS[packed & 7], 0).astype(np.float32)
    # equal ids stand together: the square norm adds twice the products of the pairs in a run
    square = (weights * weights).sum(axis=1)
    for step in range(1, ids.shape[1]):
        same = (ids[:, step:] == ids[:, :-step]) & (ids[:, step:] > 0)
        if not same.any():
            break
        square += 2 * (weights[:, step:] * weights[:, :-step] * same).sum(axis=1)
    return ids, weights / np.sqrt(np.maximum(square, 1e-12))[:, None]


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WINDOW) -> np.ndarray:
    place = starts[:, None] + np.arange(width)
    return np.where(place < ends[:, None], _CODE[data[np.minimum(place, len(data) - 1)]], 0)


@dataclass
class Machine:
    """Weight of each subsequence, bias, and the slope and offset that give a probability."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Decision value of each word: that of its most toxic window."""
        word, shift = _windows(ends - starts)
        begin, end = starts[word] + shift, np.minimum(ends[word], starts[word] + shift + WINDOW)
        out = np.full(len(starts), -np.inf, dtype=np.float32)
        sizes = end - begin
        for lo, hi in ((0, 8), (8, 14), (14, 22), (22, WINDOW)):
            sel = np.flatnonzero((sizes > lo) & (sizes <= hi))
            for k in range(0, len(sel), 8192):
                part = sel[k : k + 8192]
                ids, weights = subsequences(_codes(data, begin[part], end[part], hi))
                np.maximum.at(out, word[part], (self.table[ids] * weights).sum(axis=1) + np.float32(self.bias))
        return out

    def of_texts(self, column) -> np.ndarray:
        """Decision value of each text: that of its most toxic word, -1 without words."""
        data, words = letters(column)
        out = np.full(len(column), -np.inf, dtype=np.float32)
        if len(words.hashes):
            _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            np.maximum.at(out, words.text_of(), self.margins(data, words.starts[first], words.ends[first])[back])
        for text, spelled in _spelled(data, words):
            own = np.frombuffer(spelled, np.uint8)
            out[text] = max(out[text], self.margins(own, np.array([0]), np.array([len(own)]))[0])
        return np.where(np.isfinite(out), out, np.float32(-1))

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * margins.astype(float) + self.offset)))


def _kernel(words: list[bytes], table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Kernel values of words of at most WINDOW letters with landmarks: `place` maps a subsequence to a row of `table` (row 0 is zero)."""
    out = np.zeros((len(words), table.shape[1]), dtype=np.float32)
    for k in range(0, len(words), 1024):
        part = words[k : k + 1024]
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(w) for w in part])
        ids, weights = subsequences(_codes(data, ends - [len(w) for w in part], ends))
        dense = np.zeros((len(part), table.shape[0]), dtype=np.float32)
        np.add.at(dense, (np.repeat(np.arange(len(part)), ids.shape[1]), place[ids].reshape(-1)), weights.reshape(-1))
        dense[:, 0] = 0
        out[k : k + 1024] = dense @ table
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps."""
    x1 = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-3
    for _ in range(25):
        slack = 1 - y * (x1 @ w)
        on = slack > 0
        grad = reg * w - x1[on].T @ (c[on] * y[on] * slack[on])
        step = np.linalg.solve((x1[on] * c[on][:, None]).T @ x1[on] + np.diag(reg), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _in_windows(words: list[bytes]) -> list[bytes]:
    """The distinct windows of words, in order."""
    word, shift = _windows(np.array([len(w) for w in words]))
    return list(dict.fromkeys(words[k][a : a + WINDOW] for k, a in zip(word.tolist(), shift.tolist())))


def _fit(positive: list[bytes], negative: list[bytes]) -> Machine:
    """Nyström machine on words; landmarks are spread over both classes."""
    step = lambda items, n: items[:: max(1, len(items) // n)][:n]
    positive, negative = _in_windows(positive), _in_windows(negative)
    marks = step(positive, LANDMARKS * 3 // 4) + step(negative, LANDMARKS // 4)
    data, ends = np.frombuffer(b"".join(marks), np.uint8), np.cumsum([len(w) for w in marks])
    ids, weights = subsequences(_codes(data, ends - [len(w) for w in marks], ends))
    known = np.unique(ids[ids > 0])
    place = np.zeros(64**3, dtype=np.int64)
    place[known] = np.arange(1, len(known) + 1)
    table = np.zeros((len(known) + 1, len(marks)), dtype=np.float32)
    np.add.at(table, (place[ids].reshape(-1), np.repeat(np.arange(len(marks)), ids.shape[1])), weights.reshape(-1))
    table[0] = 0
    values, vectors = np.linalg.eigh((table.T @ table).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T  # inverse square root of the landmarks' kernel
    x = _kernel(positive + negative, table, place) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.r_[np.full(len(positive), 10.0), np.full(len(negative), 10.0 * max(1.0, len(positive) / max(1, len(negative))))]
    w, bias = _squared_hinge(x, y, c)
    full = np.zeros(64**3, dtype=np.float32)
    full[known] = (table @ (root @ w)).astype(np.float32)[1:]
    return Machine(full, bias)


def _variants(words: list[bytes]) -> list[bytes]:
    """Each word with a letter inserted, with one doubled, and with another inserted elsewhere; fixed choices, so that training repeats."""
    out = []
    for n, w in enumerate(words):
        if len(w) >= 4:
            k = 1 + n % (len(w) - 1)
            j = 1 + (n * 7 + 3) % (len(w) - 1)
            out += [w[:k] + bytes([0x61 + (n * 11) % 26]) + w[k:], w[:j] + w[j - 1 :], w[:j] + b"xzqvj"[n % 5 : n % 5 + 1] + w[j:]]
    return out


def train(texts: list[str], toxic: list[int]) -> Machine:
    """Machine from labelled texts.  Without texts of both classes nothing can be told apart: all margins are -1."""
    none = Machine(np.zeros(64**3, np.float32), -1.0, 4.0, -2.0)
    label = np.array(toxic, dtype=bool)
    if not label.any() or label.all():
        return none
    data, words = letters(pa.array(texts, pa.string()))
    if not len(words.hashes):
        return none
    _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, ends = words.starts[first], words.ends[first]
    text = words.text_of()
    packed = np.unique(text * len(first) + back)
    pairs = np.stack(np.divmod(packed, len(first)), axis=1)
    hit = label[pairs[:, 0]]
    in_toxic, in_clean = (np.bincount(pairs[m, 1], minlength=len(first)) for m in (hit, ~hit))
    belief = np.log((in_toxic + 0.05) / (label.sum() + 1)) - np.log((in_clean + 0.05) / ((~label).sum() + 1)) + 0.3 * np.log1p(in_toxic)
    clean_words = np.flatnonzero((in_clean > 0) & (ends > starts))
    word = lambda k: data[starts[k] : ends[k]].tobytes()
    hard = clean_words[np.argsort(-in_clean[clean_words], kind="stable")][:POOL]
    # words that only toxic documents have, after too many different words for chance (odds of e^-12); copies of a document count once so
    after = np.r_[-1, back[:-1]]
    after[words.bounds[:-1][np.diff(words.bounds) > 0]] = -1
    contexts = np.bincount(np.unique((back * (len(first) + 1) + after + 1)[label[text]]) // (len(first) + 1), minlength=len(first))
    sure = np.flatnonzero((in_clean == 0) & (contexts * np.log(len(label) / label.sum()) >= 12))
    machine, value = none, belief
    toxic_pairs = pairs[hit]
    for _ in range(ROUNDS):
        order = np.lexsort((-value[toxic_pairs[:, 1]], toxic_pairs[:, 0]))
        best = toxic_pairs[order][np.r_[True, np.diff(toxic_pairs[order][:, 0]) > 0]][:, 1]
        chosen = np.unique(np.r_[best[in_clean[best] == 0], sure])
        if not len(chosen):
            break
        chosen = chosen[np.argsort(-in_toxic[chosen], kind="stable")]
        plain = [word(k) for k in chosen]
        machine = _fit(plain + _variants(plain), [word(k) for k in hard])
        value = machine.margins(data, starts, ends)
        hard = np.unique(np.r_[hard[: POOL // 2], clean_words[np.argsort(-value[clean_words], kind="stable")][:POOL]])
        hard = hard[np.argsort(-value[hard], kind="stable")]
    machine.slope, machine.offset = _platt(machine.of_texts(pa.array(texts, pa.string())), label)
    return machine


def _platt(margins: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic curve, by Newton steps with a weak prior."""
    x, y = np.stack([margins.astype(float), np.ones(len(margins))], axis=1), label.astype(float)
    w = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + 0.05 * (w - [2.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.1), float(w[1])


def _score(machine: Machine):
    def run(batches):
        for batch in batches:
            for a, z in slices_of(batch.column(1), 4 << 20):
                part = batch.slice(a, z - a)
                score = machine.probability(machine.of_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["id", "score"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, train_total: int = TRAIN_TOTAL) -> Machine:
    """A machine from labelled rows: of each class, rows in order of their ids' hash, `train_docs` ids and `train_total` characters at most, with texts of at most `train_chars` characters.

    An id that has several texts gives the least one; an id with both labels stands in both classes.  Null labels and texts are left out.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= train_chars)
    turn = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)  # over at most train_docs rows
    texts, marks = [], []
    for label in (0, 1):
        part = bounded_sample(known.where(F.col("label") == label).select("id").distinct(), "id", train_docs).orderBy(F.xxhash64("id"), "id").limit(train_docs)
        chosen = own.join(F.broadcast(part), "id").groupBy("id").agg(F.min("text").alias("text"))
        taken = chosen.withColumn("upto", F.sum(F.length("text")).over(turn)).where(F.col("upto") <= train_total)
        rows = [r.text for r in taken.select("id", "text").orderBy("id").collect()]
        texts += rows
        marks += [label] * len(rows)
    return train(texts, marks)


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row: score in 0 to 1 from the whole text alone; predicted is 1 at `threshold` or more.

    Null, empty and letterless texts have the score of the margin -1.  Repeated rows have equal scores; extra columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_score(machine), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
