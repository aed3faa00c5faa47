"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that the merge procedure leaves at its end. An automaton over
the vocabulary names, for every position, the tokens that end there; of these the one is right that may follow the last
token of the prefix before it. Two tokens may stand side by side if no merge across their border would come before the
merges that build the tokens themselves. The ids follow from the end of the piece by the back-pointers.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_out, lean, slices, tidy

#: The published split of the byte-level vocabulary before merges, with Unicode white space written out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Below this code point the standard library's faster matcher does the same with its classes written out.
PLAIN_END = 0x300


def plain_classes() -> tuple[str, str]:
    """The letters and the numbers below PLAIN_END, as the inside of a character class."""
    return tuple("".join(f"\\x{c:02x}" if c < 256 else f"\\u{c:04x}" for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")


def plain_pieces() -> re.Pattern:
    letters, digits = plain_classes()
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{SPACE}{letters}{digits}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


NEVER = 1 << 60
#: Pieces kept in a worker's memo before the older half goes; longer pieces than LONG are not kept. Pairs kept.
MEMO, LONG, PAIRS = 200_000, 64, 400_000


def byte_names() -> dict[str, int]:
    """The printable character that the byte-level vocabulary writes for each byte, by a rule: shown bytes stand for themselves, the others take the code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Memo(dict):
    """Ids of pieces as bytes, in two generations: when the young one is full it becomes the old one."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", self.encode(piece.encode())).tobytes()
        if len(piece) <= LONG:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PrefixBpe:
    """The tables of one byte-level vocabulary, and the encoder and decoder over them."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        raw = {token: bytes(names[c] for c in token) for token in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]))
        self.by_bytes = {}
        for token, i in ids.items():
            self.token_bytes[i] = raw[token]
            self.by_bytes[raw[token]] = i
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = ids[left + right]
            self.rank[ids[left], ids[right]] = rank
            halves.setdefault(whole, (ids[left], ids[right]))
        self.halves = halves
        self.right_spine = functools.lru_cache(maxsize=65536)(functools.partial(self._spine, side=1))
        self.left_spine = functools.lru_cache(maxsize=65536)(functools.partial(self._spine, side=0))
        self.ends = ahocorasick.Automaton()
        for i, token in enumerate(self.token_bytes):
            # a token that no merge builds can't come out of the merge procedure
            if token and (len(token) == 1 or i in halves) and self.by_bytes.get(token) == i:
                self.ends.add_word(token.decode("latin-1"), (len(token), i))
        self.ends.make_automaton()
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for content, i in self.added.items():
            self.token_bytes[i] = content.encode()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.any_pieces = regex.compile(PIECES).findall
        self.plain_pieces = plain_pieces().findall
        self.beyond_plain = re.compile(rf"[^\x00-\u{PLAIN_END - 1:04x}]").search
        self.fits: dict[int, bool] = {}
        self.memo = Memo(self.encode_piece)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outer byte of a token up to the token: each node with the rank of the merge that takes it up."""
        up, chain_ = NEVER, []
        while True:
            chain_.append((token, up))
            if token not in self.halves:
                return chain_[::-1]
            up = self.rank[self.halves[token]]
            token = self.halves[token][side]

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether the merge procedure leaves a then b as they are, with nothing around them.

        The border's neighbours grow bottom-up in the order of their merges. A merge across the border wins if it comes
        before both next merges; of equal merges the leftmost comes first.
        """
        known = self.fits.get(a << 20 | b)
        if known is not None:
            return known
        left, right, i, j, ok = self.right_spine(a), self.left_spine(b), 0, 0, True
        while True:
            (u, up_u), (v, up_v) = left[i], right[j]
            across = self.rank.get((u, v), NEVER)
            if across < up_u and across <= up_v and across < NEVER:
                ok = False
                break
            if up_u == NEVER and up_v == NEVER:
                break
            if up_u <= up_v:
                i += 1
            else:
                j += 1
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[a << 20 | b] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the last token of every prefix, then the way back from the end."""
        whole = self.by_bytes.get(piece)
        n = len(piece)
        if whole is not None and n == 1:
            return [whole]
        last, size = [0] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (length, token) in self.ends.iter(piece.decode("latin-1")):  # the longest first
            here = end + 1
            if size[here]:
                continue
            if here == length:
                last[here], size[here] = token, length
            elif size[here - length]:
                before = last[here - length]
                fit = fits.get(before << 20 | token)
                if fit or fit is None and self.pair_fits(before, token):
                    last[here], size[here] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def encode_to_bytes(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. The strings of added tokens give their own ids."""
        if self.split_added and any(a in text for a in self.added):
            return b"".join(self.added[part].to_bytes(4, "little") if part in self.added else self._plain(part) for part in self.split_added.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        pieces = self.any_pieces(text) if self.beyond_plain(text) else self.plain_pieces(text)
        return b"".join(map(self.memo.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        return ids_of(self.encode_to_bytes(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def ids_of(raw: bytes) -> array:
    out = array("I")
    out.frombytes(raw)
    return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves on request.

    A null text counts as empty: no ids, and the digests of nothing. Repeated rows give repeated rows; other columns are
    left out. Work is row by row, so any partitioning is right and nothing is shuffled; a worker holds the vocabulary,
    a bounded memo of pieces and one batch.
    """
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {key}, n_tokens bigint, ids_sha256 string" + (", decoded_sha256 string" if decode else "") + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        sha = hashlib.sha256
        for batch in slices(batches, "text"):
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            kept = []
            for text in batch.column("text").to_pylist():
                raw = bpe.encode_to_bytes(text) if text else b""
                out["n_tokens"].append(len(raw) // 4)
                out["ids_sha256"].append(sha(raw).hexdigest())
                if decode:
                    out["decoded_sha256"].append(sha(bpe.decode(ids_of(raw)).encode()).hexdigest())
                if keep_ids:
                    kept.append(raw)
            if keep_ids:
                ends = np.cumsum([0, *out["n_tokens"]])
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(kept), np.int32)))
            out[id_col] = batch.column("id").cast(kind := batch.schema.field("id").type)
            fields = [(id_col, kind), ("n_tokens", pa.int64()), ("ids_sha256", pa.string())]
            fields += [("decoded_sha256", pa.string())] * decode + [("ids", pa.list_(pa.int32()))] * keep_ids
            yield batches_out(out, pa.schema(fields))

    return lean(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
