"""Context-mixing range coder for token ids, many blocks in lockstep.

Three orders predict the next id.  Order 2 and order 1 hold, per hashed context, the id that came last and how
sure it is; order 0 holds the counts of all ids of the block, renewed at fixed steps.  An id is one symbol: which order
predicts it first, or an escape.  The chances of the four come from two adaptive tables (by how sure orders 2 and 1 are, and by
the two symbols before), mixed by weights that follow how well each table has predicted of late.
Order 0 then codes the id's share of the counts, an escape the id's share of a fixed falling slope.  The shares
drive an arithmetic coder of 64 bits with 16-bit output words and carry.  All arithmetic is on integers, so that
every machine decodes what any other has coded.

A block starts with empty tables and shares nothing with others, so any number of blocks
advance together as the columns of arrays; a block carries its id count and a CRC-32 of its ids.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048  # ids a block
LANES = 2048  # blocks that advance together
MAX_ID = (1 << 16) - 1
SLOTS = 1024  # hashed contexts of order 1 and of order 2, each, in a block
TOGETHER = 128  # blocks whose ids are put in order together
SURE = 3  # highest certainty of a slot
RATE = 4  # shift of the tables' moving averages
CHUNK = 16  # ids of a block whose shares are put together at once; all RENEWALS are multiples
EVERY = 8  # ids after which the mixing weights are renewed
ONE = 1 << 12  # a table's chances add up to about this
#: Ids before which order 0 is renewed from the block's ids so far.
RENEWALS = (16, 48, 128, 256, 512, 1024, 1536)
WEIGHTS = 13  # what the two mixing weights share out; each has one more
_U = np.uint64
_WORD, _LEAST = _U(16), _U(1 << 48)
_ID = np.int32((1 << 17) - 1)  # a slot is certainty << 17 | id + 1
_HASH_1, _HASH_2, _HASH_3, _SHIFT = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0x2C1B3C6D, 22))
#: The four chances of a table's row stand in one integer of four 16-bit fields, which are added, weighted and summed together.
_FIELDS = _U(0x0001000100010001)
_EVEN = _FIELDS * _U(ONE >> 2)
_KEPT = _FIELDS * _U((1 << 16 - RATE) - 1)

_slope = np.concatenate([[0], np.cumsum(1 + (1 << 14) // (np.arange(MAX_ID + 1) + 128))])  # lesser ids are commoner in public vocabularies
_AT = np.repeat(np.arange(MAX_ID + 1), np.diff(_slope)).astype(np.int64)
_BEGIN, _WIDER = _slope[:-1].astype(_U), (np.diff(_slope) - 1).astype(_U)
_WHOLE = int(_slope[-1])


class CorruptBlock(ValueError):
    """A block's ids don't have its checksum."""


class _Chances:
    """The two tables of all lanes.  `shares` gives the running sums of the four symbols' shares in 16-bit fields, `came_true` takes which symbol came."""

    def __init__(self, lanes: int):
        self.row_0 = np.arange(lanes) * 16
        self.chances = [np.full(lanes * 16, _EVEN, dtype=_U) for _ in range(2)]
        self.came = [np.ones(lanes, dtype=_U) for _ in range(2)]  # chances that each table lately gave to what came
        self.steps = 0

    def shares(self, sure: np.ndarray, before: np.ndarray) -> np.ndarray:
        """`sure`: rows of the first table by how sure orders 2 and 1 are; `before`: rows of the second one by the two symbols before."""
        if self.steps % EVERY == 0:
            both = self.came[0] + self.came[1]
            self.weight = self.came[0] * _U(WEIGHTS) // both + _U(1)
            self.other = _U(WEIGHTS + 2) - self.weight
            for c in self.came:
                c >>= _U(1)
                c += _U(1)
        self.steps += 1
        self.rows = [self.row_0 + sure, self.row_0 + before]
        self.given = [c.take(r) for c, r in zip(self.chances, self.rows)]
        upto = self.given[0] * self.weight
        upto += self.given[1] * self.other
        upto *= _FIELDS
        return upto

    def came_true(self, shift: np.ndarray) -> None:
        """`shift`: 16 times the symbol."""
        more = _U(ONE >> RATE) << shift
        for c, r, g, t in zip(self.chances, self.rows, self.given, self.came):
            t += g >> shift & _U(0xFFFF)
            lost = g >> _U(RATE)
            lost &= _KEPT
            g -= lost
            g += more
            c[r] = g


class _Mixer:
    """Contexts of all lanes, for decoding.  `look` gives the candidates (id + 1, 0 for none) and the running sums of the shares, `learn` takes what came."""

    def __init__(self, lanes: int):
        self.tables = _Chances(lanes)
        self.slot_0 = np.arange(lanes) * SLOTS
        self.slots = [np.zeros(lanes * SLOTS, dtype=np.int32) for _ in range(2)]
        self.last = [np.zeros(lanes, dtype=np.uint32) for _ in range(2)]
        self.before = np.zeros(lanes, dtype=np.int64)  # the two symbols before

    def look(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.at = [self.slot_0 + h for h in _contexts(*self.last)]
        second, first = (s.take(k) for s, k in zip(self.slots, self.at))
        self.ids = [second & _ID, first & _ID]
        self.sure = [second >> 17, first >> 17]
        return *self.ids, self.tables.shares((self.sure[0] << 2) + self.sure[1] * (self.ids[0] != self.ids[1]), self.before)

    def learn(self, symbol: np.ndarray, shift: np.ndarray, ids: np.ndarray) -> None:
        self.tables.came_true(shift)
        came = (ids + 1).astype(np.int32)
        for s, k, held, sure in zip(self.slots, self.at, self.ids, self.sure):
            sure *= held == came
            sure += 1
            np.minimum(sure, SURE, out=sure)
            sure <<= 17
            sure += came
            s[k] = sure
        self.last = [ids.astype(np.uint32), self.last[0]]
        self.before = (self.before & 3) << 2 | symbol


def _contexts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of order 2 and order 1 after the ids b, a."""
    one = a * _HASH_1
    return (b * _HASH_2 ^ one) * _HASH_3 >> _SHIFT, one >> _SHIFT


def _held(slot: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a _Mixer's slot holds when each id of (lanes, steps) comes: the id that came last in it + 1, 0 for none, and how sure it is (at most SURE, 3).

    The ids of a slot are put beside each other: a slot is surer by one for each time in a row that an id came again.
    """
    lanes, steps = mine.shape
    order = np.argsort(slot, axis=1, kind="stable")
    order += (np.arange(lanes) * steps)[:, None]
    order = order.reshape(-1)
    slot, came = slot.reshape(-1).take(order).reshape(lanes, steps), mine.reshape(-1).take(order).reshape(lanes, steps)
    same = slot[:, 1:] == slot[:, :-1]
    again = same & (came[:, 1:] == came[:, :-1])
    after = np.ones((lanes, steps), dtype=np.uint8)  # how sure a slot is once the id has come
    after[:, 1:] += again
    after[:, 2:] += again[:, 1:] & again[:, :-1]
    held, sure = np.zeros((lanes, steps), dtype=np.int32), np.zeros((lanes, steps), dtype=np.uint8)
    held[:, 1:] = (came[:, :-1] + np.int32(1)) * same
    sure[:, 1:] = after[:, :-1] * same
    ids, sures = np.empty(lanes * steps, dtype=np.int32), np.empty(lanes * steps, dtype=np.uint8)
    ids[order], sures[order] = held.reshape(-1), sure.reshape(-1)
    return ids.reshape(lanes, steps), sures.reshape(lanes, steps)


def _symbols(mine: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id of (lanes, steps), turned: its symbol, and its rows in the two tables of chances; `share` is that of order 0, turned."""
    lanes, steps = mine.shape
    symbol, sure = np.empty((steps, lanes), dtype=np.uint8), np.empty((steps, lanes), dtype=np.uint8)
    for a in range(0, lanes, TOGETHER):
        own = mine[a : a + TOGETHER]
        last = np.zeros((len(own), steps + 2), dtype=np.uint32)
        last[:, 2:] = own
        two, one = (h.astype(np.uint16) for h in _contexts(last[:, 1:-1], last[:, :-2]))
        (second, sure_2), (first, sure_1) = _held(two, own), _held(one, own)
        came = own + np.int32(1)
        new = (share[:, a : a + TOGETHER] == 0).T
        symbol[:, a : a + TOGETHER] = ((came != second) * (1 + (came != first) * (1 + new.astype(np.uint8)))).T
        sure[:, a : a + TOGETHER] = ((sure_2 << 2) + sure_1 * (second != first)).T
    before = np.zeros((steps, lanes), dtype=np.uint8)
    before[1:] = symbol[:-1]
    before[2:] += symbol[:-2] << 2
    return symbol, sure, before


def _order_0(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each id of (lanes, steps), turned: where its share of the counts at the last renewal begins, and the share; 0 where it has not come before that."""
    lanes, steps = mine.shape
    begin, share = np.zeros((steps, lanes), dtype=np.uint16), np.zeros((steps, lanes), dtype=np.uint16)
    for a in range(0, lanes, TOGETHER):
        _order_0_of(mine[a : a + TOGETHER], begin[:, a : a + TOGETHER], share[:, a : a + TOGETHER])
    return begin, share


def _order_0_of(mine: np.ndarray, begin: np.ndarray, share: np.ndarray) -> None:
    lanes, steps = mine.shape
    order = np.argsort(mine, axis=1, kind="stable")
    order += (np.arange(lanes) * steps)[:, None]
    order = order.reshape(-1)
    ordered = mine.reshape(-1).take(order).reshape(lanes, steps)
    fresh = np.zeros((lanes, steps), dtype=np.int32)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    np.cumsum(fresh, axis=1, out=fresh)
    kinds = int(fresh.max()) + 1
    fresh += (np.arange(lanes, dtype=np.int32) * kinds)[:, None]
    rank = np.empty(lanes * steps, dtype=np.int32)
    rank[order] = fresh.reshape(-1)
    rank = np.ascontiguousarray(rank.reshape(lanes, steps).T)
    counts = np.zeros(lanes * kinds, dtype=np.int32)
    edges = [0, *(e for e in RENEWALS if e < steps), steps]
    for a, b, c in zip(edges, edges[1:], edges[2:]):
        counts += np.bincount(rank[a:b].reshape(-1), minlength=lanes * kinds)
        upto = np.cumsum(counts.reshape(lanes, kinds), axis=1, dtype=np.int32).reshape(-1)
        own = counts.take(rank[b:c])
        share[b:c] = own
        begin[b:c] = upto.take(rank[b:c]) - own


class _Counts:
    """Order 0 for decoding, from the ids so far in order: a place in the counts to its id, where the id's share begins and where it ends, in fields of one integer."""

    def __init__(self, ids: np.ndarray):
        self.n, lanes = ids.shape
        place = np.arange(self.n, dtype=np.uint16)
        self.fields = np.empty((lanes, self.n), dtype=_U)
        for a in range(0, lanes, TOGETHER):
            ordered = np.sort(np.ascontiguousarray(ids[:, a : a + TOGETHER].T), axis=1, kind="stable")
            begin, end = np.zeros(ordered.shape, dtype=np.uint16), np.full(ordered.shape, self.n, dtype=np.uint16)
            fresh = ordered[:, 1:] != ordered[:, :-1]
            begin[:, 1:] = fresh * place[1:]
            end[:, :-1][fresh] = np.broadcast_to(place[1:], fresh.shape)[fresh]
            np.maximum.accumulate(begin, axis=1, out=begin)
            end = np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1]
            own = self.fields[a : a + TOGETHER]
            own[:] = end
            own <<= _WORD
            own |= begin
            own <<= _WORD
            own |= ordered
        self.fields = self.fields.reshape(-1)

    def find(self, lane: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.fields.take(lane * self.n + value).view(np.int64)
        return found & 0xFFFF, found >> 16 & 0xFFFF, found >> 32


def _together(sizes: list[int]):
    """Groups of at most LANES blocks, the longest first: the longest of a group decides how many steps are taken."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    return (order[a : a + LANES] for a in range(0, len(order), LANES))


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of ids; ids over MAX_ID are refused."""
    out: list[bytes] = [b""] * len(blocks)
    for part in _together([len(b) for b in blocks]):
        for k, payload in zip(part, _encode([blocks[k] for k in part])):
            out[k] = payload
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    lanes, steps = len(blocks), max(map(len, blocks), default=0)
    if not steps:
        return [b""] * lanes
    if any(len(b) and b.dtype != np.uint16 and not 0 <= int(b.min()) <= int(b.max()) <= MAX_ID for b in blocks):
        raise ValueError(f"ids are 0 to {MAX_ID}")
    sizes = np.array([len(b) for b in blocks])
    mine = np.zeros((lanes, steps), dtype=np.uint16)
    for row, b in zip(mine, blocks):
        row[: len(b)] = b
    begin, share = _order_0(mine)
    symbols, sure, before = _symbols(mine, share)
    ids = np.ascontiguousarray(mine.T)
    tables, lane = _Chances(lanes), np.arange(lanes)
    low, span = np.zeros(lanes, dtype=_U), np.full(lanes, 2**64 - 1, dtype=_U)
    room = steps * 3 + 8  # an id takes 34 bits at most
    words = np.zeros((room, lanes), dtype=np.uint32)  # 16 bits of each, and carries that aren't added yet
    flat, at = words.reshape(-1), lane.copy()

    def move(start: np.ndarray) -> None:
        nonlocal low
        low = low + start
        over = low < start
        if over.any():
            flat[at[over] - lanes] += np.uint32(1)

    live, renewed = lanes, 0  # lanes go by falling size: the first `live` ones are still on
    for t in range(steps):
        if t in RENEWALS:
            renewed = t
        while sizes[live - 1] <= t:
            live -= 1
        if live < lanes:
            off = slice(live, None)
            held = low[off].copy(), span[off].copy()
        if t % CHUNK == 0:
            part = slice(t, t + CHUNK)
            symbol, own = symbols[part], ids[part]
            shifts = symbol.astype(_U) << _U(4)
            fresh, deeper = symbol == 3, symbol > 1
            inner = np.where(fresh, _BEGIN.take(own), begin[part] * deeper)
            wide = np.where(fresh, _WIDER.take(own) + _U(1), np.where(deeper, share[part], 1).astype(_U))
            whole = np.array([1, 1, max(renewed, 1), _WHOLE], dtype=_U).take(symbol)
        k = t % CHUNK
        shift = shifts[k]
        upto = tables.shares(sure[t], before[t])
        below = upto << _WORD
        below >>= shift
        below &= _U(0xFFFF)
        step = span // (upto >> _U(48))
        start = below * step
        upto >>= shift
        upto &= _U(0xFFFF)
        upto -= below
        step *= upto
        span = step // whole[k]
        start += inner[k] * span
        span *= wide[k]
        if live < lanes:
            start[off] = 0
        move(start)
        if live < lanes:
            low[off], span[off] = held
        small = span < _LEAST
        flat[at] = low >> _U(48)  # counts where the place moves on
        at += small * np.int64(lanes)
        bits = small.astype(_U) << _U(4)
        low <<= bits
        span <<= bits
        while len(more := np.flatnonzero(span < _LEAST)):  # few need a second word
            flat[at[more]] = low[more] >> _U(48)
            at[more] += lanes
            low[more] <<= _WORD
            span[more] <<= _WORD
        tables.came_true(shift)
    move(np.full(lanes, (1 << 48) - 1, dtype=_U))  # one word more is enough: the span holds a multiple of 2**48
    flat[at] = low >> _U(48)
    words = words[: int(at.max()) // lanes + 1]
    while (over := words >> 16).any():
        words &= np.uint32(0xFFFF)
        words[:-1] += over[1:]
    own = np.ascontiguousarray(words.T.astype("<u2"))
    return [own[k, : at[k] // lanes + 1].tobytes() if sizes[k] else b"" for k in range(lanes)]


def decode_blocks(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids of each block from its payload and id count."""
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(payloads)
    for part in _together(sizes):
        for k, ids in zip(part, _decode([payloads[k] for k in part], [sizes[k] for k in part])):
            out[k] = ids
    return out


def _decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    lanes, steps = len(payloads), max(sizes, default=0)
    room = max(map(len, payloads), default=0) // 2 + 8
    own = np.zeros((lanes, room), dtype=np.uint16)
    for row, p in zip(own, payloads):
        row[: len(p) // 2] = np.frombuffer(p, dtype="<u2")
    words = np.ascontiguousarray(own.T).reshape(-1)
    mixer, lane = _Mixer(lanes), np.arange(lanes)
    at, code = lane.copy(), np.zeros(lanes, dtype=_U)
    for _ in range(4):
        code = (code << _WORD) | words[at]
        at += lanes
    span = np.full(lanes, 2**64 - 1, dtype=_U)
    ids = np.zeros((steps, lanes), dtype=np.uint16)
    counts = None
    for t in range(steps):
        if t in RENEWALS:
            counts = _Counts(ids[:t])
        second, first, upto = mixer.look()
        total = upto >> _U(48)
        step = span // total
        value = np.minimum(code // step, total - _U(1))
        symbol = (value >= (upto & _U(0xFFFF))).astype(np.int64)
        for k in (16, 32):
            symbol += value >= (upto >> _U(k) & _U(0xFFFF))
        shift = symbol.astype(_U) << _U(4)
        below = (upto << _WORD) >> shift & _U(0xFFFF)
        code -= below * step
        span = ((upto >> shift & _U(0xFFFF)) - below) * step
        own = np.where(symbol == 0, second, first).astype(np.int64) - 1
        which = np.flatnonzero(symbol == 2)
        if len(which):
            inside = span.take(which) // _U(counts.n if counts else 1)
            value = np.minimum(code.take(which) // inside, _U((counts.n if counts else 1) - 1)).astype(np.int64)
            found, inner, outer = counts.find(which, value) if counts else (0 * value, 0 * value, 0 * value + 1)
            own[which] = found
            code[which] -= inner.astype(_U) * inside
            span[which] = (outer - inner).astype(_U) * inside
        which = np.flatnonzero(symbol == 3)
        if len(which):
            inside = span.take(which) // _U(_WHOLE)
            found = _AT.take(np.minimum(code.take(which) // inside, _U(_WHOLE - 1)).astype(np.int64))
            own[which] = found
            code[which] -= _BEGIN.take(found) * inside
            span[which] = (_WIDER.take(found) + _U(1)) * inside
        np.maximum(own, 0, out=own)  # only past the end of a shorter block
        small = span < _LEAST
        bits = small.astype(_U) << _U(4)
        code <<= bits
        code |= words.take(at, mode="clip") * small
        at += small * np.int64(lanes)
        span <<= bits
        for _ in range(2):  # few need a second word
            more = np.flatnonzero(span < _LEAST)
            if not len(more):
                break
            code[more] = code[more] << _WORD | words.take(at[more], mode="clip")
            at[more] += lanes
            span[more] <<= _WORD
        np.maximum(span, _LEAST, out=span)  # as above: a span of a coded id is never less
        ids[t] = own
        mixer.learn(symbol, shift, own)
    flat = np.ascontiguousarray(ids.T)
    return [row[:n] for row, n in zip(flat, sizes)]


def id_bytes(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(ids).astype("<u4").tobytes()


def checked(ids: np.ndarray, crc: int) -> np.ndarray:
    if zlib.crc32(id_bytes(ids)) != crc:
        raise CorruptBlock(f"block of {len(ids)} ids doesn't have checksum {crc:#x}")
    return ids


_REVERSED_POLYNOMIAL = 0xEDB88320  # CRC-32, fixed by its definition
_shifts: list[list[int]] = []


def _apply(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def _shift_matrix(power: int) -> list[int]:
    """What 2**power zero bytes do to a CRC register, as columns over GF(2)."""
    if not _shifts:
        bit = [_REVERSED_POLYNOMIAL] + [1 << k for k in range(31)]
        for _ in range(3):  # one bit, two, four, eight
            bit = [_apply(bit, c) for c in bit]
        _shifts.append(bit)
    while len(_shifts) <= power:
        _shifts.append([_apply(_shifts[-1], c) for c in _shifts[-1]])
    return _shifts[power]


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings' concatenation from their CRCs and the length of the second one."""
    power = 0
    while second_bytes >> power:
        if second_bytes >> power & 1:
            first = _apply(_shift_matrix(power), first)
        power += 1
    return first ^ second
