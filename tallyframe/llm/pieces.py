"""SentencePiece encoding and decoding with a streaming Viterbi search.

The public model at hand is a BPE model, for which a best-scoring unigram path
would give other ids than the model's own.  The search therefore runs over the
lattice of pieces with the BPE consistency condition as its score: a piece may
follow another one only if merging the two alone leaves them apart.  A sequence
of pieces is the BPE encoding exactly if all neighbours are consistent, and each
position has exactly one piece that ends there in the encoding of the prefix, so
the search keeps one backpointer a position.  Only positions within the longest
piece's length can be continued; whenever the paths of all of them go back to
one boundary, the ids before it are committed.

At a pair of characters that no piece holds all surviving paths meet, so the text before it is committed as it
stands, without looking further; what was searched between two such boundaries is kept in a bounded table and
not searched again when it comes again.  Every text goes through the stream in parts, and the stream holds no
more than HELD characters that aren't committed, however long the text or a word in it is.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .spark_io import free_name

SPACE = "▁"
_WORD = re.compile(" *[^ ]+| +")
MEMO_WORDS = 800_000
MEMO_PAIRS = 1_000_000
PART = 1 << 16  # characters of a text that are pushed at once
HELD = 64  # characters of a word that wait for its end; of longer ones, what isn't committed waits


class Pieces:
    """Pieces of a BPE model with byte fallback: text, score and id of each."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.raw = {}, {}, []
        self.bytes = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.raw.append(b"")
            elif model.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                self.raw.append(piece.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    self.ids[piece], self.scores[piece] = i, model.get_score(i)
        self.longest = max(map(len, self.ids))
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.names = {i: p for p, i in self.ids.items()}
        self.sizes = _Sizes(self.ids)
        self._pairs: dict[int, bool] = {}
        self.words = _Words(self)

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by repeated merging: the highest score first, the leftmost on ties."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def consistent(self, left: int, right: int) -> bool:
        """Whether piece `right` may follow piece `left` (-1: the start, or a character without a piece)."""
        key = (left << 20) | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            b = self.names[right]
            a = self.names.get(left, "")
            known = self._pairs[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def extend(self, text: str, ends: list[int], last: int) -> None:
        """Append to `ends` the piece that ends at each further character; -1 stands for a character without a piece."""
        known, pairs, sizes = self.ids.get, self._pairs.get, self.sizes
        for end in range(len(ends) + 1, len(text) + 1):
            for size in sizes[text[end - 3 if end > 2 else 0 : end]]:
                start = end - size
                if start >= 0:
                    piece = known(text[start:end])
                    if piece is not None:
                        left = ends[start - 1] if start else last
                        ok = pairs((left << 20) | piece)
                        if ok or (ok is None and self.consistent(left, piece)):
                            ends.append(piece)
                            break
            else:
                ends.append(-1)

    def path(self, text: str, ends: list[int], upto: int) -> list[int]:
        """Ids of the pieces on the path that ends at `upto`."""
        out = []
        while upto > 0:
            piece = ends[upto - 1]
            if piece < 0:
                out += [self.bytes[b] for b in reversed(text[upto - 1].encode("utf-8", "surrogatepass"))]
                upto -= 1
            else:
                out.append(piece)
                upto -= len(self.names[piece])
        return out[::-1]

    def decode(self, ids) -> str:
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 16-bit integers, by the stream."""
        if not text:
            return b""
        stream = TextStream(self)
        if len(text) <= PART:
            return stream.push(text) + stream.finish()
        return b"".join([stream.push(text[k : k + PART]) for k in range(0, len(text), PART)]) + stream.finish()


class _Sizes(dict):
    """The last three characters of a text to the lengths, longest first, of the pieces that can end there."""

    def __init__(self, pieces):
        super().__init__()
        self.pieces, self.long = pieces, {}
        for p in pieces:
            if len(p) > 3:
                self.long.setdefault(p[-3:], set()).add(len(p))

    def __missing__(self, tail: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[tail] = out = (*sorted(self.long.get(tail, ()), reverse=True), *(n for n in (3, 2, 1) if tail[-n:] in self.pieces and n <= len(tail)))
        return out


class _Words(dict):
    """Word without the one space before it to its ids, filled by the search on demand and emptied when full."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.spans = pieces, {}

    def __missing__(self, word: str) -> bytes:
        out = StreamingViterbi(self.pieces).push(SPACE + word.replace(" ", SPACE), whole=True)
        ids = struct.pack(f"<{len(out)}H", *out)
        if len(word) <= HELD:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class StreamingViterbi:
    """Push text in parts (spaces as the model has them), get ids as soon as they are certain.

    `ends[k]` is the piece that ends k + 1 characters after the last committed boundary.  The text before that boundary
    is dropped; only the last committed piece is kept, because the next one must be consistent with it.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.text, self.ends, self.last = pieces, "", [], -1
        self.before, self.widest = "", 0  # the last character pushed, the most characters that were held

    def push(self, text: str, whole: bool = False) -> list[int]:
        """`whole`: the text ends here, where all paths meet."""
        out, inner, step = [], self.pieces.inner, 4 * self.pieces.longest
        start, n = 0, len(text)
        if n and self.before + text[0] not in inner:
            out += self.finish()
        for k in range(1, n + 1):
            meet = whole if k == n else text[k - 1 : k + 1] not in inner
            if meet or k == n or k - start >= step:
                if meet and k - start < step and self.last < 0 and not self.text:
                    out += self._between(text[start:k])
                else:
                    self.text += text[start:k]
                    self.widest = max(self.widest, len(self.text))
                    self.pieces.extend(self.text, self.ends, self.last)
                    out += self._commit(self._common())
                    if meet:
                        out += self.finish()
                start = k
        self.before = text[-1:] or self.before
        return out

    def finish(self) -> list[int]:
        out = self._commit(len(self.ends))
        self.last = -1
        return out

    def _between(self, span: str) -> list[int]:
        """Ids of a span between boundaries, short ones from the table."""
        known = self.pieces.words.spans.get(span)
        if known is None:
            ends: list[int] = []
            self.pieces.extend(span, ends, -1)
            known = self.pieces.path(span, ends, len(span))
            if len(span) <= 4:
                spans = self.pieces.words.spans
                if len(spans) >= MEMO_WORDS // 8:
                    spans.clear()
                spans[span] = known
        return known

    def _back(self, k: int) -> int:
        piece = self.ends[k - 1]
        return k - (1 if piece < 0 else len(self.pieces.names[piece]))

    def _common(self) -> int:
        """The last boundary that lies on the paths of all positions which a later piece may continue."""
        alive = set(range(max(0, len(self.ends) - self.pieces.longest + 1), len(self.ends) + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(self._back(top))
        return alive.pop()

    def _commit(self, upto: int) -> list[int]:
        out = self.pieces.path(self.text, self.ends, upto)
        if upto:
            self.last = self.ends[upto - 1]
        self.text, self.ends = self.text[upto:], self.ends[upto:]
        return out


class TextStream:
    """Push a text in parts of any size, get its ids (little-endian 16-bit integers) as soon as they are certain.

    A word ends where a space follows another character, which no piece spans: all paths meet there and the word's ids are
    committed.  The last word of a part waits for its end up to HELD characters; what a longer one has goes into the search.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.tail, self.search, self.blank = pieces, " ", None, True

    def push(self, text: str) -> bytes:
        text = self.tail + text.replace(SPACE, " ")
        out = []
        if self.search:
            end = text.find(" ", len(text) - len(text.lstrip(" ")) if self.blank else 0)
            out.append(self._long(text if end < 0 else text[:end]))
            if end < 0:
                return out[0]
            out.append(self._ended())
            text = text[end:]
        parts = text.split(" ")  # the text begins with a space
        if parts.count("") > 1:
            parts = ["", *(w[1:] for w in _WORD.findall(text))]
        self.tail = " " + parts.pop()
        words = iter(parts)
        next(words)  # nothing stands before the first space
        out += map(self.pieces.words.__getitem__, words)
        if len(self.tail) > HELD:
            self.search, self.blank = StreamingViterbi(self.pieces), True
            out.append(self._long(self.tail))
            self.tail = ""
        return b"".join(out)

    def finish(self) -> bytes:
        if self.search:
            return self._ended()
        out, self.tail = self.pieces.words[self.tail[1:]], " "
        return out

    def _long(self, text: str) -> bytes:
        self.blank = self.blank and not text.strip(" ")
        ids = self.search.push(text.replace(" ", SPACE))
        return struct.pack(f"<{len(ids)}H", *ids)

    def _ended(self) -> bytes:
        ids = self.search.finish()
        self.search = None
        return struct.pack(f"<{len(ids)}H", *ids)


_loaded: dict[str, Pieces] = {}


def load_pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _encode(path: str, position: int, check: bool):
    def run(batches):
        pieces = load_pieces(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, sizes, same = [], [], []
                for text in part.column(position).to_pylist():
                    own = np.frombuffer(pieces.encode(text or ""), dtype="<u2")
                    ids.append(own)
                    sizes.append(len(own))
                    if check:
                        same.append(pieces.decode(own.tolist()) == (text or "").replace(SPACE, " "))
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                extra = [column, pa.array(same, pa.bool_())] if check else [column]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[str(k) for k in range(len(part.columns) + len(extra))])

    return run


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """`docs`, all columns, with `ids_col` array<int>: the ids of the whole text; an existing column of that name is replaced.

    With `check_col`, also whether decoding the ids gives the text back, where U+2581 counts as a space as the model has it.
    A null or empty text has no ids.  Ties and repeated rows are rows like any others; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    base = docs.drop(ids_col, *([check_col] if check_col else []))
    names = [free_name(base, "ids_out"), free_name(base, "same_out")]
    schema = ", ".join([f"`{i}` {f.dataType.simpleString()}" for i, f in enumerate(base.schema)] + [f"`{names[0]}` array<int>"] + ([f"`{names[1]}` boolean"] if check_col else []))
    out = base.mapInArrow(_encode(model_path, base.columns.index(text_col), bool(check_col)), schema)
    return out.toDF(*base.columns, ids_col, *([check_col] if check_col else []))


def decode_ids(frame: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`frame`, all columns, with `text_col` decoded from `ids_col`; null ids give null, ids outside the model an error."""
    ship(frame.sparkSession)

    @F.pandas_udf("string")
    def decode(ids):
        pieces = load_pieces(model_path)
        return ids.map(lambda x: None if x is None else pieces.decode(list(x)))

    return frame.withColumn(text_col, decode(ids_col))
