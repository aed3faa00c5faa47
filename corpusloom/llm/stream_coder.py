"""Adaptive context-mixing range coder for token ids, over many blocks and several streams in each at once.

Blocks are independent: each begins with a reset model. A block is cut into STREAMS equal parts (the last id is repeated to
fill them), each with a range coder of its own; at every step all streams of all blocks advance one id, as numpy arrays.
The streams of a block learn one model together. An id is predicted by the last two ids (order 2), by the last one
(order 1) and by its frequency in the block so far (order 0). The first two name an id each with a confidence, kept in
tables that follow every id. An id's probability is a mixture: a share for each named id, and the rest dealt by order-0
frequencies, in which ids that the block hasn't had yet share an escape and then follow a fixed distribution over the
vocabulary. The shares are learnt for every pair of confidences. They and the frequencies are counted anew at the steps of
TURNS, so a decoder finds an id by one look into a table.

The range coder has 48 bits, writes 16 at a time and carries into what it has written, so it needs one write a symbol.
"""

from __future__ import annotations

import functools

import numpy as np

#: Ids in a block, and streams that share its model.
BLOCK, STREAMS = 4096, 16
#: Slots for contexts of two and of one id.
SLOTS2, SLOTS1 = 4096, 2048
#: Steps of a stream before which shares and frequencies are counted anew.
TURNS = (2, 4, 8, 16, 32, 64, 96, 128, 192)
#: Totals as powers of two: of the mixture, and of order-0 frequencies. Order 0 has a share of 2^ORDER0_BITS at least.
BITS, ORDER0_BITS = 16, 12
ALL, TOTAL0 = 1 << BITS, 1 << ORDER0_BITS
LEAST, MASK = 1 << 32, (1 << 32) - 1
#: Pairs of confidences (order 2 times 4, order 1), and again for two names of the same id; a symbol is of one of three kinds.
STATES = 32
WEIGHT2, WEIGHT1 = (0, 3, 5, 7), (0, 2, 3, 4)
#: What a reset model takes as counted, by state: order 2 right, order 1 right, neither.
PRIOR = np.array([(a := WEIGHT2[s >> 2 & 3], 0 if s >> 4 else (8 - a) * WEIGHT1[s & 3] / 8, 1 + (8 - a) / 2) for s in range(STATES)]) * 4
PRIOR = PRIOR.astype(np.int64)


@functools.lru_cache(maxsize=2)
def vocabulary(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of each id, of ALL in total, for ids that a block hasn't had; and the id at every place."""
    if not 0 < ids < ALL:
        raise ValueError("a vocabulary of 1 to 65,535 ids is needed")
    share = 1 / (np.arange(ids) + 1000.0)
    freq = 1 + np.floor((ALL - ids) * share / share.sum()).astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(freq)])
    borders[-1] = ALL
    return borders, np.repeat(np.arange(ids), np.diff(borders))


def frequencies(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ids its distinct ones in ascending order, and last the escape: id, begin and length as one number.

    Also where each row's numbers begin. An escape has ALL - 1 for its id, which no id is.
    """
    n, m = seen.shape
    if not m:
        return np.full(n, TOTAL0 << 32 | (ALL - 1)), np.arange(n + 1)
    ids = np.sort(seen, axis=1, kind="stable")
    new = np.ones((n, m), bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
    at = np.flatnonzero(new)
    row, distinct = at // m, new.sum(1)
    escape = np.minimum(np.maximum(32, TOTAL0 * distinct // (m + distinct)), (TOTAL0 - distinct) // 2)
    freq = 1 + np.diff(at, append=n * m) * (TOTAL0 - distinct - escape)[row] // m
    first = np.concatenate([[0], np.cumsum(distinct)])
    upto = np.concatenate([[0], np.cumsum(freq)])
    begin = upto[:-1] - upto[first[:-1]][row]
    used = upto[first[1:]] - upto[first[:-1]]
    starts = first + np.arange(n + 1)
    out = np.empty(len(at) + n, np.int64)
    out[np.arange(len(at)) + row] = freq << 32 | begin << 16 | ids.ravel()[at]
    out[starts[1:] - 1] = (TOTAL0 - used) << 32 | used << 16 | (ALL - 1)
    return out, starts


def shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where order 1's share begins and order 0's, for every state of every block."""
    c = counts.reshape(-1, 3)
    free, n = ALL - TOTAL0 - 2, c.sum(1)
    first = 1 + free * c[:, 0] // n
    return first.astype(np.int32), (first + 1 + free * c[:, 1] // n).astype(np.int32)


class Contexts:
    """What orders 2 and 1 name, for all streams; a block's tables begin at its base."""

    def __init__(self, blocks: int):
        block = np.repeat(np.arange(blocks, dtype=np.int32), STREAMS)
        self.base2, self.base1, self.base = block * SLOTS2, block * SLOTS1, block * STATES
        self.order2, self.order1 = np.zeros(blocks * SLOTS2, np.uint32), np.zeros(blocks * SLOTS1, np.uint32)
        self.last, self.before = np.zeros(blocks * STREAMS, np.uint32), np.zeros(blocks * STREAMS, np.uint32)

    def predict(self, w: int) -> np.ndarray:
        """The states of the first w streams."""
        h = self.last[:w] * np.uint32(2654435761)
        self.at1 = ((h >> np.uint32(21)).view(np.int32) + self.base1[:w]).astype(np.intp)
        h ^= self.before[:w] * np.uint32(2246822519)
        self.at2 = ((h >> np.uint32(20)).view(np.int32) + self.base2[:w]).astype(np.intp)
        self.e2, self.e1 = self.order2.take(self.at2), self.order1.take(self.at1)
        self.c2, self.c1 = self.e2 >> np.uint32(2), self.e1 >> np.uint32(2)
        self.k2, self.k1 = self.e2 & np.uint32(3), self.e1 & np.uint32(3)
        return (self.k2 << np.uint32(2) | self.k1 | (self.c1 == self.c2).view(np.uint8).astype(np.uint32) << np.uint32(4)).view(np.int32) + self.base[:w]

    def learn(self, x: np.ndarray) -> None:
        one, fresh = np.uint32(1), x << np.uint32(2) | np.uint32(1)
        for table, at, e, c, k in ((self.order2, self.at2, self.e2, self.c2, self.k2), (self.order1, self.at1, self.e1, self.c1, self.k1)):
            table[at] = np.where(c == x, e + (k < 3), np.where(k > one, e - one, fresh))
        w = len(x)
        self.before[:w] = self.last[:w]
        self.last[:w] = x


def turns(longest: int) -> list[tuple[int, int]]:
    """Stretches of steps with the same shares and frequencies."""
    cuts = [0, *(t for t in TURNS if t < longest), longest]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def laid_out(sizes: list[int]) -> tuple[list[int], np.ndarray]:
    """The order of blocks by falling length, and the steps of each."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    return order, np.array([-(-sizes[i] // STREAMS) for i in order])


def encode_blocks(blocks: list[np.ndarray], ids: int) -> list[bytes]:
    """The code of each block of at most BLOCK ids, all below ``ids`` (less than 2^16)."""
    codes = [b""] * len(blocks)
    order, steps = laid_out([len(b) for b in blocks])
    n = int(np.count_nonzero(steps))
    if not n:
        return codes
    order, steps, longest = order[:n], steps[:n], int(steps[0])
    table = np.zeros((n, STREAMS, longest), np.uint16)
    for row, i in enumerate(order):
        own, m = blocks[i], int(steps[row])
        if own.min() < 0 or own.max() >= ids or len(own) > BLOCK:
            raise ValueError("an id outside the vocabulary, or a block of too many")
        padded = np.full(m * STREAMS, own[-1])
        padded[: len(own)] = own
        table[row, :, :m] = padded.reshape(STREAMS, m)
    width = n * STREAMS
    by_step = np.ascontiguousarray(table.reshape(width, longest).T)
    live = [int(np.searchsorted(-steps, -t, "left")) for t in range(longest + 1)]  # blocks longer than t

    contexts = Contexts(n)
    state, kind = np.zeros((longest, width), np.int32), np.full((longest, width), 2, np.uint8)
    for t in range(longest):
        w = live[t] * STREAMS
        x = by_step[t, :w].astype(np.uint32)
        state[t, :w] = contexts.predict(w)
        k = kind[t, :w]
        k[contexts.c1 == x] = 1
        k[contexts.c2 == x] = 0
        contexts.learn(x)

    begin, length = np.zeros((longest, width), np.int32), np.ones((longest, width), np.int32)
    unseen = np.zeros((longest, width), bool)
    counts = np.tile(PRIOR, (n, 1))
    lut = np.zeros(ALL, np.int64)
    for a, b in turns(longest):
        now = live[a]
        w = now * STREAMS
        first, second = shares(counts[: now * STATES])
        packed, starts = frequencies(table[:now, :, :a].reshape(now, -1))
        mine, escapes = packed & (ALL - 1), packed[starts[1:] - 1]
        found = np.empty((b - a, w), np.int64)
        for row, (i, j) in enumerate(zip(starts[:-1].tolist(), (starts[1:] - 1).tolist(), strict=True)):
            lut[mine[i:j]] = packed[i:j]
            lanes = slice(row * STREAMS, (row + 1) * STREAMS)
            found[:, lanes] = lut[by_step[a:b, lanes]]
            lut[mine[i:j]] = 0
        for t in range(a, b):
            k, own = kind[t, :w], state[t, :w]
            f1, f2 = first.take(own), second.take(own)
            head, size = begin[t, :w], length[t, :w]
            head[:] = np.where(k == 1, f1, 0)
            size[:] = np.where(k == 1, f2 - f1, f1)
            rest = np.flatnonzero(k == 2)
            got, f2 = found[t - a, rest], f2[rest].astype(np.int64)
            new = got == 0
            got = np.where(new, escapes[rest // STREAMS], got)
            unseen[t, rest] = new
            share, low0 = ALL - f2, got >> 16 & 0xFFFF
            low = share * low0 >> ORDER0_BITS
            head[rest], size[rest] = f2 + low, (share * (low0 + (got >> 32)) >> ORDER0_BITS) - low
        w = live[b - 1] * STREAMS
        counts[: live[b - 1] * STATES] += np.bincount((state[a:b, :w] * 3 + kind[a:b, :w]).ravel(), minlength=live[b - 1] * STATES * 3).reshape(-1, 3)

    borders, _ = vocabulary(ids)
    out, pos = np.zeros(((2 * longest + 1), width), np.uint32), np.zeros(width, np.int64)
    flat, lane = out.reshape(-1), np.arange(width)
    low, span = np.zeros(width, np.int64), np.full(width, 1 << 48)
    for t in range(longest):
        w = live[t] * STREAMS
        l, s = low[:w], span[:w]
        unit = s >> BITS
        l += unit * begin[t, :w]
        np.multiply(unit, length[t, :w], out=s)
        full = np.flatnonzero(s < LEAST)
        at, have = pos[full], l[full]
        flat[at * width + full] = have >> 32
        pos[full] = at + 1
        l[full] = (have & MASK) << 16
        s[full] <<= 16
        full = np.flatnonzero(unseen[t, :w])
        if len(full):
            x = by_step[t, full]
            unit = s[full] >> BITS
            have, left = l[full] + unit * borders[x], unit * (borders[x + np.int64(1)] - borders[x])
            short = left < LEAST
            at = pos[full]
            flat[(at * width + full)[short]] = (have >> 32)[short]
            pos[full] = at + short
            l[full], s[full] = np.where(short, (have & MASK) << 16, have), np.where(short, left << 16, left)
    flat[pos * width + lane] = low + MASK >> 32  # what follows is read as zeros
    pos += 1
    carry = np.zeros(width, np.uint32)
    for row in out[::-1]:
        row += carry
        np.right_shift(row, 16, out=carry)
        row &= np.uint32(0xFFFF)
    words = out.T[np.arange(len(out)) < pos[:, None]].astype("<u2")
    ends = np.cumsum(pos.reshape(n, STREAMS).sum(1))
    heads = pos.reshape(n, STREAMS).astype("<u2")
    for row, i in enumerate(order):
        codes[i] = heads[row].tobytes() + words[ends[row - 1] if row else 0 : ends[row]].tobytes()
    return codes


def decode_blocks(codes: list[bytes], counts: list[int], ids: int) -> list[np.ndarray]:
    """The ids of each block, given their number. Raises ValueError for lengths that don't agree, and for other damage that it sees."""
    if max(counts, default=0) > BLOCK:
        raise ValueError("a block of too many ids")
    found = [np.empty(0, np.int32)] * len(codes)
    order, steps = laid_out(counts)
    n = int(np.count_nonzero(steps))
    if not n:
        return found
    order, steps, longest = order[:n], steps[:n], int(steps[0])
    raw = [np.frombuffer(codes[i], "<u2", len(codes[i]) // 2) for i in order]
    if any(len(r) < STREAMS or int(r[:STREAMS].sum(dtype=np.int64)) != len(r) - STREAMS for r in raw):
        raise ValueError("a code of a wrong length")
    width = n * STREAMS
    lengths = np.concatenate([r[:STREAMS] for r in raw]).astype(np.int64)
    deep = max(2 * longest + 4, int(lengths.max()))
    words = np.zeros((width, deep), np.uint16)
    words[np.arange(deep) < lengths[:, None]] = np.concatenate([r[STREAMS:] for r in raw])
    flat, at_word = words.reshape(-1), np.arange(width) * deep + 3
    code = words[:, 0].astype(np.int64) << 32 | words[:, 1].astype(np.int64) << 16 | words[:, 2]
    span = np.full(width, 1 << 48)
    borders, at_place = vocabulary(ids)
    table, by_step = np.zeros((n, STREAMS, longest), np.uint16), np.zeros((longest, width), np.uint16)
    live = [int(np.searchsorted(-steps, -t, "left")) for t in range(longest + 1)]
    place = np.repeat(np.arange(n) * TOTAL0, STREAMS)
    contexts = Contexts(n)
    tally = np.tile(PRIOR, (n, 1))
    for a, b in turns(longest):
        now = live[a]
        first, second = shares(tally[: now * STATES])
        packed, _ = frequencies(table[:now, :, :a].reshape(now, -1))
        slots = np.repeat(packed, packed >> 32)
        state, kind = np.zeros((b - a, now * STREAMS), np.int32), np.zeros((b - a, now * STREAMS), np.uint8)
        for t in range(a, b):
            w = live[t] * STREAMS
            c, s = code[:w], span[:w]
            st = contexts.predict(w)
            f1, f2 = first.take(st), second.take(st)
            unit = s >> BITS
            v = np.minimum(c / unit, ALL - 1.0).astype(np.int32)  # exact: the numbers have 48 and 32 bits
            k = (v >= f1).view(np.uint8) + (v >= f2)
            x = np.where(k == 0, contexts.c2, contexts.c1)
            begin, end = np.where(k == 0, 0, f1), np.where(k == 0, f1, f2)
            rest = np.flatnonzero(k == 2)
            of2 = f2[rest].astype(np.int64)
            share = ALL - of2
            got = slots.take(place[rest] + (((v[rest] - of2 + 1 << ORDER0_BITS) - 1) / share).astype(np.int64), mode="clip")
            low0 = got >> 16 & 0xFFFF
            begin[rest], end[rest] = of2 + (share * low0 >> ORDER0_BITS), of2 + (share * (low0 + (got >> 32)) >> ORDER0_BITS)
            name = got & (ALL - 1)
            x[rest] = name
            c -= unit * begin
            np.multiply(unit, end - begin, out=s)
            full = np.flatnonzero(s < LEAST)
            at = at_word[full]
            c[full] = c[full] << 16 | flat.take(at)
            s[full] <<= 16
            at_word[full] = at + 1
            full = rest[name == ALL - 1]
            if len(full):
                unit = s[full] >> BITS
                i = at_place.take(np.minimum(c[full] / unit, ALL - 1.0).astype(np.int64), mode="clip")
                have, left = c[full] - unit * borders[i], unit * (borders[i + 1] - borders[i])
                short = left < LEAST
                at = at_word[full]
                c[full], s[full] = np.where(short, have << 16 | flat.take(at), have), np.where(short, left << 16, left)
                at_word[full] = at + short
                x[full] = i
            by_step[t, :w] = x
            state[t - a, :w], kind[t - a, :w] = st, k
            contexts.learn(x)
        table.reshape(width, longest)[:, a:b] = by_step[a:b].T
        now = live[b - 1]
        w = now * STREAMS
        tally[: now * STATES] += np.bincount((state[:, :w] * 3 + kind[:, :w]).ravel(), minlength=now * STATES * 3).reshape(-1, 3)
    for row, i in enumerate(order):
        own = table[row, :, : steps[row]].reshape(-1).astype(np.int32)
        found[i] = own[: counts[i]]
        if (own[counts[i] :] != own[counts[i] - 1]).any():
            raise ValueError("a code is damaged where it fills its streams")
    return found
