"""Token-set similarity of names, 0 to 100."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit a character of `a`."""
    where: dict[str, int] = {}
    for k, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * common_subsequence(a, b) / total if total else 100.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Best of three comparisons of shared words and shared-plus-own words; 100 if one word set holds the other, 0 if either is empty."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not left or not right):
        return 100.0
    with_left, with_right = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    ratios = [indel_ratio(with_left, with_right)]
    if shared:
        ratios += [indel_ratio(shared, with_left), indel_ratio(shared, with_right)]
    return max(ratios)


@lru_cache(maxsize=1 << 16)  # names often recur in other blocks
def own_words_ratio(a: str, b: str) -> float:
    """That of token_set_ratio's comparisons which the shared words don't decide: shared-plus-own words of both."""
    x, y = set(a.split()), set(b.split())
    shared = sorted(x & y)
    return indel_ratio(" ".join(shared + sorted(x - y)), " ".join(shared + sorted(y - x)))


class Names:
    """Word sets, joined forms and letter counts of names."""

    def __init__(self, names: list[str]):
        self.words = [sorted(set(n.split())) for n in names]
        self.joined = [" ".join(w) for w in self.words]
        self.size = np.array([len(j) for j in self.joined], dtype=np.int32)
        self.count = np.array([len(w) for w in self.words], dtype=np.int32)

    def letters(self, alphabet: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(self.joined), len(alphabet)), dtype=np.int16)
        for row, joined in zip(out, self.joined):
            for ch in joined:
                if ch in alphabet:
                    row[alphabet[ch]] += 1
        return out

    def incidence(self, vocabulary: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(self.words), len(vocabulary)), dtype=np.float32)
        for row, words in zip(out, self.words):
            row[[vocabulary[w] for w in words if w in vocabulary]] = 1
        return out


def close_pairs(left: list[str], right: list[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of all pairs whose rounded token-set ratio is at the threshold, and the ratio.

    Bounds over all pairs at once come first: the two comparisons with the shared words are exact, as these are the beginning of both, and
    the letters in common bound the third, so that few pairs are compared by edits.
    """
    a, b, least = Names(left), Names(right), threshold - 0.5
    common = {w for words in a.words for w in words} & {w for words in b.words for w in words}
    vocabulary = {w: k for k, w in enumerate(sorted(common))}
    x, y = a.incidence(vocabulary), b.incidence(vocabulary)
    n = x @ y.T
    width = ((x * np.array([len(w) for w in vocabulary], dtype=np.float32)) @ y.T + n - 1).astype(np.float64)
    some = n > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        held = np.where(some, np.maximum(200.0 * width / (width + a.size[:, None]), 200.0 * width / (width + b.size[None, :])), 0)
    whole = some & ((n == a.count[:, None]) | (n == b.count[None, :]))
    alphabet = {ch: k for k, ch in enumerate(sorted({ch for j in a.joined for ch in j} & {ch for j in b.joined for ch in j}))}
    p, q = a.letters(alphabet), b.letters(alphabet)
    bag = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(len(alphabet)):
        bag += np.minimum.outer(p[:, k], q[:, k])
    total = np.maximum(a.size[:, None] + b.size[None, :], 1)
    bound = np.where((a.count[:, None] > 0) & (b.count[None, :] > 0), 200.0 * bag / total, 0)
    i, j = np.nonzero(whole | (held >= least) | (bound >= least))
    ratio = np.array([100 if all_in else round(max(by_shared, own_words_ratio(a.joined[s], b.joined[t]))) for s, t, all_in, by_shared in zip(i.tolist(), j.tolist(), whole[i, j].tolist(), held[i, j].tolist())], dtype=np.int32)
    good = ratio >= threshold
    return i[good], j[good], ratio[good]


@F.pandas_udf(IntegerType())
def _rounded(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[tuple, int] = {}
    for a, b in pairs:
        out = []
        for key in zip(a, b):
            if key not in known:
                if len(known) > 200_000:
                    known.clear()
                known[key] = round(token_set_ratio(*key))
            out.append(known[key])
        yield pd.Series(out, dtype="int32")


def token_set_similarity(a, b):
    """Column of rounded ratios; an Arrow function, as no built-in expression compares word sets by edits."""
    return _rounded(a, b)
