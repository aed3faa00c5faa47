"""Recompression of word sequences, as numpy work on one text at a time.

A text is a sequence of 64-bit word hashes. A round first replaces maximal runs of an equal symbol, then, with the
alphabet split in left and right by a bit of the symbol, every left symbol that a right one follows. A new symbol's name
is a 64-bit hash of what it stands for, so every task gives equal things equal names without asking anyone. Different
things may get one name; names only gather candidates, and what they stand for is compared by digests of the words
themselves (``digests``). With every symbol goes its context: the span of words that settle that the symbol stands there. A window of words that holds a
symbol's context holds the symbol at the same place wherever else the window occurs.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U = np.uint64
MUL1, MUL2, GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
BASE = U(0xD1342543DE82EF95)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ROUNDS = 2
LEVEL = np.arange(1, 65, dtype=np.uint64) * U(0x8CB92BA72F3D8DD7)
#: The power of two that a range of so many windows has room for.
SPAN = np.array([0, *(n.bit_length() - 1 for n in range(1, 1 << 12))])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MUL1
    x = (x ^ (x >> U(27))) * MUL2
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as a text has needed them."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1 << 16), powers(INVERSE, 1 << 16)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            if n > 1 << 24:  # a very long text has its own, not kept
                return powers(BASE, n), powers(INVERSE, n)
            size = 1 << (n - 1).bit_length()
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        return self.up, self.down


POWERS = Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of a sequence of 64-bit values: the same for equal spans, wherever they are."""
    up, down = POWERS.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLD)


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text and where its words start and end."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~WHITE[data]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return data, change[0::2], change[1::2]


#: Bytes of a word that are read eight at a time; longer words are hashed whole.
LONG_WORD = 512
#: The low bytes of eight, by number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time, each step a bijection of the one before."""
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(sizes.astype(np.uint64) * GOLD)
    live, at = np.arange(len(starts)), 0
    while len(live):
        left = sizes[live] - at
        out[live] = mix((out[live] ^ (eight[starts[live] + at] & LOW_BYTES[np.minimum(left, 8)])) * MUL1 + GOLD)
        at += 8
        live = live[(left > 8) & (sizes[live] <= LONG_WORD)]
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words of several texts: their bytes with one space between two words and one line break between two texts,
    where each word starts and ends in them, their names and sizes, and where each text's words begin, with their number.

    Work on texts together costs far less than on one at a time. No word reaches over the line break between two.
    """

    def __init__(self, raws: list[bytes]):
        self.raw = b"\n".join([b" ".join(r.split()) for r in raws])  # on bytes, split() takes the ASCII white space alone
        data, self.starts, self.ends = word_spans(self.raw)
        breaks = np.flatnonzero(data == 10)
        begins = np.concatenate(([0], breaks + 1)) if len(raws) else np.zeros(1, np.int64)
        self.offsets = np.append(np.searchsorted(self.starts, begins), len(self.starts))
        self.names, self.sizes = word_names(data, self.starts, self.ends), self.ends - self.starts

    def digests(self, first: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
        """64 bits of a keyed cryptographic digest of the words [first, end), as they are written, for each pair.

        With a key that is drawn anew for every run nobody can have made words whose digests are equal.
        """
        raw = self.raw
        found = b"".join([blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(self.starts[first].tolist(), self.ends[end - 1].tolist(), strict=True)])
        return np.frombuffer(found, "<u8")


def levels(words: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """(names, sizes in bytes, context starts, context ends): of the words, of their runs, and of the symbols after each round of pairs.

    Two equal neighbours are of one kind, so a run never breaks or makes a pair at its inside, and pairs need not know
    about runs. A run's name tells that it is maximal, so its context takes in both neighbours. A context that would
    reach over an end of the text gets a start or end far outside, so no window holds it.
    """
    n, far = len(words), 1 << 40
    names, a, b = words, np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    length = np.diff(np.append(first, n))
    first, length = first[length > 1], length[length > 1]
    ends = first + length
    runs = (mix(names[first] + length.astype(np.uint64) * GOLD), sizes[first], np.where(first, first - 1, -far), np.where(ends < n, ends + 1, far))
    out = [(names, sizes, a, b), runs]
    for r in range(rounds):
        if len(names) < 2:
            break
        right = ((names * GOLD) >> U(40 + r)) & U(1) == 1
        taken, second = np.zeros(len(names), bool), np.zeros(len(names), bool)
        taken[:-1] = ~right[:-1] & right[1:]
        second[1:] = taken[:-1]
        # a left symbol is alone because of what follows, a right one because of what goes before
        b2 = np.where(right, b, np.append(b[1:], far))
        a2 = np.where(right & ~second, np.append(-far, a[:-1]), a)
        a2[:-1] = np.where(taken[:-1], np.minimum(a[:-1], a[1:]), a2[:-1])
        paired = mix(names * MUL2 + np.append(names[1:], U(0)) * GOLD + LEVEL[r])
        keep = ~second
        sizes = (sizes + np.where(taken, np.append(sizes[1:], 0), 0))[keep]
        names, a, b = np.where(taken, paired, names)[keep], np.minimum(a2, a)[keep], np.maximum(b2, b)[keep]
        out.append((names, sizes, a, b))
    return out


def window_keys(words: np.ndarray, sizes: np.ndarray, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """For every window of ``width`` words the symbol that stands for it: of the symbols whose context it holds, one of
    the highest level, there the longest in bytes, as long ones are rare, there the largest hash. It depends on the words
    of the window alone."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    best = np.zeros(n, np.uint64)
    for level, (names, size, a, b) in reversed(list(enumerate(levels(words, sizes, rounds)))):
        prio = (mix(names + LEVEL[level]) >> U(10)) | (np.minimum(size, 127).astype(np.uint64) << U(54)) | (U(level) << U(61))
        first, last = np.maximum(b - width, 0), np.minimum(a, n - 1)  # the windows that hold the context
        fit = np.flatnonzero(last >= first)
        if not len(fit):
            continue
        prio, first, last = prio[fit], first[fit], last[fit]
        # two overlapping spans of a power of two cover each range; the larger spans then pass on to the smaller
        power = SPAN[np.minimum(last - first + 1, len(SPAN) - 1)]
        here = np.zeros(n, np.uint64)
        for j in range(int(power.max()), -1, -1):
            if j < int(power.max()):
                wider = here
                here = wider.copy()
                half = 1 << j
                np.maximum(here[half:], wider[:-half], out=here[half:])
            sel = power == j
            if sel.any():
                np.maximum.at(here, first[sel], prio[sel])
                if j:
                    np.maximum.at(here, last[sel] - (1 << j) + 1, prio[sel])
        np.maximum(best, here, out=best)
        if best.all():
            break
    return best


def segments(words: Words, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(keys, starts, ends, texts): maximal runs of windows of one text with one key; the run's windows start at the words
    [start, end) of the joined texts, so it covers the words [start, end + width - 1).

    Windows that reach over the end of a text don't count, and no symbol whose context does stands for one that counts.
    """
    keys = window_keys(words.names, words.sizes, width, rounds)
    n = len(keys)
    none = np.empty(0, np.int64)
    if not n:
        return keys, none, none, none
    text = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    whole = text[:n] == text[width - 1 : width - 1 + n]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (keys[1:] != keys[:-1]) | (text[1:n] != text[: n - 1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return keys[:0], none, none, none
    ends = starts + np.add.reduceat(whole.astype(np.int64), starts)  # windows that count are together
    return keys[starts], starts, ends, text[starts]
