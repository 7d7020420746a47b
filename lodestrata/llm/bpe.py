"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a pre-token the table holds the one token that ends the prefix's encoding. A token t
that ends at i is that token exactly if it starts the pre-token, or if it may follow the token that ends
the encoding of what precedes it: two tokens may be neighbours if the merges would not have joined
bytes across their boundary earlier. Whether they may is decided by undoing the merges of both, newest
first, so no text is merged anew. An append only extends the table; an edit recomputes it from the edited
byte until its entries fall in with the old ones.

Defined results: a null text counts as empty (no ids, decoded to no bytes); repeated rows and extra
columns pass through, but a column of an output's name gives way to it; texts and pre-tokens of any length are
encoded whole, and only short ones are remembered; two tokens never have one rank, so that there are no ties; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestrata.llm.common import Remembered, flushed

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Most pre-tokens that a worker remembers, and the longest one that it does.
CACHE_ENTRIES, CACHE_CHARS, PAIR_ENTRIES = 300_000, 48, 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixTable:
    """The encodings of all prefixes of one pre-token; append() and edit() keep it exact."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.codec.extend(self.data, self.last, len(self.data))

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace data[at:at + removed]; the number of entries computed anew. Entries depend on the codec's
        longest token's worth of bytes before them, so that many equal entries in a row end the work."""
        old, shift, run, done = self.last, len(inserted) - removed, 0, 0
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.last = old[:at]
        for end in range(at + 1, len(self.data) + 1):
            self.codec.extend(self.data, self.last, end)
            done += 1
            if end > at + len(inserted):
                run = run + 1 if self.last[-1] == old[end - shift - 1] else 0
                if run >= self.codec.longest:
                    self.last += old[end - shift :]
                    break
        return done

    def ids(self) -> list[int]:
        return list(self.codec.path(self.last))


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.token = ranks, {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split_text = regex.compile(pattern).findall
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        #: The tokens that their own bytes encode to; no other can end an encoding by merges.
        self.alone = {b: i for b, i in ranks.items() if self.halves(i) != (-1, -1)}
        #: What begins such a token -> the token that it is, or -1.
        self._walk = {b[:n]: -1 for b in self.alone for n in range(1, len(b))} | self.alone
        size = max(ranks.values()) + 1
        self._first, self._second = [-1] * size, [-1] * size
        for i, two in self._halves.items():
            if two and two != (-1, -1):
                self._first[i], self._second[i] = two
        self.known = Remembered(self._encode_piece, CACHE_ENTRIES, CACHE_CHARS)

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain merging, lowest rank and then leftmost first; below: only merges of lower rank."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((r, i) for i in range(len(parts) - 1) for r in (ranks.get(parts[i] + parts[i + 1], 1 << 60),))
            if best[0] == 1 << 60 or below is not None and best[0] >= below:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte, (-1, -1) if merging never makes it."""
        if token not in self._halves:
            if self.length[token] == 1:
                self._halves[token] = None
            else:
                two = self.merged(self.token[token], below=token)
                self._halves[token] = (two[0], two[1]) if len(two) == 2 else (-1, -1)
        return self._halves[token]

    def may_follow(self, left: int, right: int) -> bool:
        if len(self._pairs) >= PAIR_ENTRIES:
            self._pairs.clear()
        known = self._pairs[left << 20 | right] = self._may_follow(left, right)
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        get, token, first, second = self.ranks.get, self.token, self._first, self._second
        limit = none = 1 << 60
        while True:
            if get(token[left] + token[right], none) < limit:
                return False
            a, b = second[left], first[right]
            if a >= 0 and (left > right or b < 0):
                limit, left = left, a
            elif b >= 0:
                limit, right = right + 1, b
            else:
                return True

    def extend(self, data: bytes, last: list[int], to: int) -> None:
        """Add the last tokens of the prefixes of data up to the length `to`. An entry is sought from the longest
        token that can end there: what starts at a place is looked up only as far as it begins some token."""
        done = len(last)
        last += [-1] * (to - done)
        walk, pairs, may_follow = self._walk.get, self._pairs.get, self.may_follow
        for start in range(max(0, done - self.longest + 1), to):
            before = last[start - 1] << 20 if start else -1
            for end in range(start + 1, to + 1):
                token = walk(data[start:end])
                if token is None:
                    break
                if token >= 0 and end > done and last[end - 1] < 0:
                    if before < 0 or (ok if (ok := pairs(before | token)) is not None else may_follow(before >> 20, token)):
                        last[end - 1] = token

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        last: list[int] = []
        self.extend(data, last, len(data))
        return self.path(last)

    def path(self, last: list[int]) -> tuple[int, ...]:
        """The tokens of the longest prefix, from the last tokens of all prefixes."""
        out, end, length = [], len(last), self.length
        while end:
            t = last[end - 1]
            out.append(t)
            end -= length[t]
        out.reverse()
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split_text(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(load_ranks(path))


@lru_cache(maxsize=4)
def _decimal(path: str) -> dict[int, str]:
    return {i: str(i) for i in codec(path).token}


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each row with `token_ids` (array of int)."""
    return _mapped(docs, path, text, [("token_ids", T.ArrayType(T.IntegerType()), lambda c, ids: ids)])


def digests(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to; with_ids: token_ids as well."""
    outputs = [
        ("n_tokens", T.LongType(), lambda c, ids: len(ids)),
        ("ids_sha256", T.StringType(), lambda c, ids: hashlib.sha256(",".join(map(_decimal(path).__getitem__, ids)).encode()).hexdigest()),
        ("decoded_sha256", T.StringType(), lambda c, ids: hashlib.sha256(c.decode(ids)).hexdigest()),
    ]
    if with_ids:
        outputs.append(("token_ids", T.ArrayType(T.IntegerType()), lambda c, ids: ids))
    return _mapped(docs.select("doc_id", text), path, text, outputs).drop(text)


def decode(rows: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Each row with `decoded` (binary); null ids decode to null."""
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            made = pa.array([None if x is None else c.decode(x) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def _mapped(docs: DataFrame, path: str, text: str, outputs: list[tuple]) -> DataFrame:
    docs = docs.drop(*(name for name, _, _ in outputs if name != text))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind, _ in outputs)])
    at = docs.columns.index(text)
    arrow = {T.ArrayType(T.IntegerType()): pa.list_(pa.int32()), T.LongType(): pa.int64(), T.StringType(): pa.string()}
    made = pa.schema([(name, arrow[kind]) for name, kind, _ in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rows = ([f(c, ids) for _, _, f in outputs] for ids in (c.encode(t.as_py() or "") for t in part.column(at)))
                for new in flushed(map(tuple, rows), made, 512):
                    yield pa.RecordBatch.from_arrays([*part.columns, *new.columns], names=[*part.schema.names, *made.names])

    return docs.mapInArrow(run, schema)
