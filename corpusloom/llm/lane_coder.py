"""The coder of the first form of token files, which are still read; ``stream_coder`` writes the present form.

An adaptive context-mixing range coder for token ids, over many blocks at once.

Blocks are independent: each begins with a reset model. All blocks of a call advance one id a step, as lanes of numpy
arrays. An id is predicted by the last two ids (order 2), by the last one (order 1) and by its frequency in the block so
far (order 0). The first two name an id each with a confidence; for every pair of confidences a block learns with which
weights the three are mixed. The mixture says whether the id is the order-2 one, the order-1 one or another; another is
coded by its order-0 frequency, as three digits, each under those before it. Frequencies are cumulative tables of a fixed
total that move towards what has occurred, and never fall to nothing. The coder is a carryless range coder of 64 bits
that writes 16 bits at a time.
"""

from __future__ import annotations

import math

import numpy as np

U = np.uint64
BOTTOM, SHIFT, TOP_SHIFT = U(1 << 48), U(16), U(48)
#: Slots for contexts of two and of one id, and ids in a block.
SLOTS2, SLOTS1, BLOCK = 4096, 2048, 4096
#: The total of a table as a power of two. Four steps of 12 bits fit between two writes.
BITS = 12
#: How slowly a table moves, as a power of two, by how often it has moved: a new one learns fast.
RATES = np.array([2, 2, 3, 3, 3, 4, 4, 4, 4, 4, *[5] * 22, *[6] * 224], np.int16)
TOTAL_SHIFT = U(BITS)


def targets(n: int) -> np.ndarray:
    """For each of n symbols the cumulative table that gives it all but 1 for every other."""
    i = np.arange(n + 1)
    return np.where(i[None, :] > np.arange(n)[:, None], (1 << BITS) - n + i[None, :], i[None, :]).astype(np.int16)


def uniform(n: int) -> np.ndarray:
    return (np.arange(n + 1) * (1 << BITS) // n).astype(np.int16)


#: By confidences (order 2 times 8, order 1): where weights are; by a confidence: what a hit and a miss add to an entry.
STATE = np.array([min(i >> 3, 3) * 4 + min(i & 7, 3) for i in range(64)])
HIT, MISS = np.array([1] * 7 + [0], np.int32), np.array([(k >> 1) - k for k in range(8)], np.int32)
#: Targets of the two borders between three kinds.
FIRST, SECOND = np.ascontiguousarray(targets(3)[:, 1]), np.ascontiguousarray(targets(3)[:, 2])


class Model:
    """Tables of all lanes one after the other, each of one dimension or of rows; a lane's begins at its base."""

    def __init__(self, lanes: int, ids: int):
        self.radix = max(2, math.ceil(round(ids ** (1 / 3), 9)))
        r = self.radix
        lane = np.arange(lanes)
        nodes = 1 + r + r * r
        self.base2, self.base1, self.base_mix, self.base_node = lane * SLOTS2, lane * SLOTS1, lane * 32, lane * nodes
        self.order2 = np.zeros(lanes * SLOTS2, np.int32)
        self.order1 = np.zeros(lanes * SLOTS1, np.int32)
        self.mix1, self.mix2 = np.full(lanes * 32, uniform(3)[1]), np.full(lanes * 32, uniform(3)[2])
        self.digits = np.tile(uniform(r), (lanes * nodes, 1))
        self.moved, self.mixed = np.zeros(lanes * nodes, np.uint8), np.zeros(lanes * 32, np.uint8)
        self.to_digit = targets(r)
        self.t1 = np.zeros(lanes, np.int64)
        self.t2 = np.zeros(lanes, np.int64)

    def predict(self) -> None:
        last = self.t1 * 40503
        self.at2 = ((last + self.t2 * 60493 >> 3) & (SLOTS2 - 1)) + self.base2
        self.at1 = (last >> 4 & (SLOTS1 - 1)) + self.base1
        self.e2, self.e1 = self.order2.take(self.at2), self.order1.take(self.at1)
        self.c2, self.k2, self.c1, self.k1 = self.e2 >> 3, self.e2 & 7, self.e1 >> 3, self.e1 & 7
        self.state = STATE.take(self.k2 << 3 | self.k1) + ((self.c1 == self.c2) << 4) + self.base_mix
        self.w1, self.w2 = self.mix1.take(self.state), self.mix2.take(self.state)

    def borders(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each lane's kind."""
        return np.where(kind == 0, 0, np.where(kind == 1, self.w1, self.w2)), np.where(kind == 0, self.w1, np.where(kind == 1, self.w2, 1 << BITS))

    def learn(self, x: np.ndarray, kind: np.ndarray) -> None:
        n = self.mixed.take(self.state)
        rate = RATES.take(n)
        self.mix1[self.state] = self.w1 + (FIRST.take(kind) - self.w1 >> rate)
        self.mix2[self.state] = self.w2 + (SECOND.take(kind) - self.w2 >> rate)
        self.mixed[self.state] = n + (n < 255)
        fresh = x << 3 | 1
        for table, at, e, c, k in ((self.order2, self.at2, self.e2, self.c2, self.k2), (self.order1, self.at1, self.e1, self.c1, self.k1)):
            table[at] = np.where(c == x, e + HIT.take(k), np.where(k > 1, e + MISS.take(k), fresh))
        self.t2, self.t1 = self.t1, x.astype(np.int64)

    def learn_digit(self, at: np.ndarray, row: np.ndarray, digit: np.ndarray) -> None:
        n = self.moved.take(at)
        row += (self.to_digit.take(digit, 0) - row) >> RATES.take(n)[:, None]
        self.digits[at] = row
        self.moved[at] = n + (n < 255)

    def shrink(self, lanes: int) -> None:
        """Go on with the first lanes; the others have ended."""
        for name in ("base2", "base1", "base_mix", "base_node", "t1", "t2"):
            setattr(self, name, getattr(self, name)[:lanes])


def ready(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose first 16 bits are settled or whose range is short; and of these, by place, those that are cut."""
    apart, short = (low ^ (low + span)) >= BOTTOM, span < BOTTOM
    go = np.flatnonzero(~apart | short)
    return go, (apart & short)[go]


def narrow(low: np.ndarray, span: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = span >> TOTAL_SHIFT
    return low + unit * start.astype(U), unit * (end - start).astype(U)


def encode_blocks(blocks: list[np.ndarray], ids: int) -> list[bytes]:
    """The code of each block of at most BLOCK ids, all below ``ids`` (at most 2^16)."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    longest = int(sizes[0])
    table = np.zeros((len(order), longest), np.int32)
    for row, i in enumerate(order):
        table[row, : sizes[row]] = blocks[i]
    n = len(order)
    model = Model(n, ids)
    radix = model.radix
    low, span = np.zeros(n, U), np.full(n, ~U(0))
    out, pos = np.zeros((n, longest * 3 + 8), np.uint16), np.zeros(n, np.int64)

    def settle(low: np.ndarray, span: np.ndarray) -> None:
        lanes, cut = ready(low, span)
        while len(lanes):
            l, s = low[lanes], span[lanes]
            s = np.where(cut, (~l + U(1)) & (BOTTOM - U(1)), s) << SHIFT
            out[lanes, pos[lanes]] = (l >> TOP_SHIFT).astype(np.uint16)
            pos[lanes] += 1
            l <<= SHIFT
            low[lanes], span[lanes] = l, s
            again, cut = ready(l, s)
            lanes = lanes[again]

    live = n
    for t in range(longest):
        now = int(np.searchsorted(-sizes, -t, "left"))  # lanes longer than t
        if now < live:
            model.shrink(now)
            live = now
        x = table[:live, t]
        model.predict()
        kind = np.where(x == model.c2, 0, np.where(x == model.c1, 1, 2))
        a, b = low[:live], span[:live]
        a[:], b[:] = narrow(a, b, *model.borders(kind))
        rest = np.flatnonzero(kind == 2)
        if len(rest):
            x_rest, la, lb = x[rest], a[rest], b[rest]
            here, base = np.arange(len(rest)) * (radix + 1), model.base_node[rest]
            d1, d3 = x_rest // (radix * radix), x_rest % radix
            d2 = x_rest // radix % radix
            for node, digit in ((np.zeros_like(d1), d1), (1 + d1, d2), (1 + radix + d1 * radix + d2, d3)):
                at = base + node
                row = model.digits.take(at, 0)
                la, lb = narrow(la, lb, row.take(here + digit), row.take(here + digit + 1))
                model.learn_digit(at, row, digit)
            a[rest], b[rest] = la, lb
        settle(a, b)
        model.learn(x, kind)
    for k in range(4):
        out[np.arange(n), pos + k] = ((low >> U(48 - 16 * k)) & U(0xFFFF)).astype(np.uint16)
    codes: list[bytes] = [b""] * n
    for row, i in enumerate(order):
        codes[i] = out[row, : pos[row] + 4].astype("<u2").tobytes()
    return codes


def decode_blocks(codes: list[bytes], counts: list[int], ids: int) -> list[np.ndarray]:
    """The ids of each block, given their number."""
    if not codes:
        return []
    order = sorted(range(len(codes)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order])
    n, longest = len(order), int(sizes[0])
    width = max(len(c) for c in codes) // 2 + 8
    words = np.zeros((n, width), np.uint16)
    for row, i in enumerate(order):
        words[row, : len(codes[i]) // 2] = np.frombuffer(codes[i], "<u2")
    code = np.zeros(n, U)
    for k in range(4):
        code = (code << SHIFT) | words[:, k].astype(U)
    pos = np.full(n, 4)
    model = Model(n, ids)
    radix = model.radix
    low, span = np.zeros(n, U), np.full(n, ~U(0))
    table = np.zeros((n, longest), np.int32)
    live = n
    for t in range(longest):
        now = int(np.searchsorted(-sizes, -t, "left"))
        if now < live:
            model.shrink(now)
            live = now
        model.predict()
        a, b, c = low[:live], span[:live], code[:live]
        value = np.minimum((c - a) // (b >> TOTAL_SHIFT), U((1 << BITS) - 1)).astype(np.int16)
        kind = (value >= model.w1).astype(np.int64) + (value >= model.w2)
        a[:], b[:] = narrow(a, b, *model.borders(kind))
        x = np.where(kind == 0, model.c2, model.c1)
        rest = np.flatnonzero(kind == 2)
        if len(rest):
            la, lb, lc = a[rest], b[rest], c[rest]
            here, base = np.arange(len(rest)) * (radix + 1), model.base_node[rest]
            node, found = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            for level in range(3):
                at = base + node
                row = model.digits.take(at, 0)
                value = np.minimum((lc - la) // (lb >> TOTAL_SHIFT), U((1 << BITS) - 1)).astype(np.int16)
                digit = (row[:, 1:] > value[:, None]).argmax(1)  # the last is above every value
                la, lb = narrow(la, lb, row.take(here + digit), row.take(here + digit + 1))
                model.learn_digit(at, row, digit)
                found = found * radix + digit
                node = found + (1 if level == 0 else 1 + radix)
            a[rest], b[rest] = la, lb
            x[rest] = found
        lanes, cut = ready(a, b)
        while len(lanes):
            l, s, at = a[lanes], b[lanes], pos[lanes]
            s = np.where(cut, (~l + U(1)) & (BOTTOM - U(1)), s) << SHIFT
            c[lanes] = (c[lanes] << SHIFT) | words[lanes, np.minimum(at, width - 1)]
            pos[lanes] = at + 1
            l <<= SHIFT
            a[lanes], b[lanes] = l, s
            again, cut = ready(l, s)
            lanes = lanes[again]
        table[:live, t] = x
        model.learn(x.astype(np.int32), kind)
    out: list[np.ndarray] = [np.empty(0, np.int32)] * n
    for row, i in enumerate(order):
        out[i] = table[row, : sizes[row]]
    return out
