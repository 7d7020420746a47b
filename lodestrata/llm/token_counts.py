"""Token counts without encoding: the whole-token shortcut.

Offline, each string of the vocabulary is merged on its own; those that come out as one token are proven
to count 1 whenever they are a whole pre-token. Counting is then a table lookup per pre-token, and only
the other pre-tokens are merged (each counted once and remembered, up to a bound).

Defined results: a null text counts as empty (0 bytes, 0 tokens). The special string counts 1 wherever
it stands in a text, as the library's default has it, and parts the text there. Texts are counted whole, at any length, with
pre-tokens of any length (by a heap from 256 bytes on); repeated rows are counted each; equal ranks don't occur, so that there are no ties;
columns of other names take no part; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestrata.llm.common import Remembered

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Counter:
    """Counts tokens by looking pre-tokens up: the proven whole tokens, and a bounded memory of the rest."""

    def __init__(self, spec: dict, pattern: str = public_tokenizers.PATTERN):
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split_text = regex.compile(pattern).findall
        back = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        as_bytes = lambda s: bytes(back[c] for c in s)
        self.rank = {(as_bytes(a), as_bytes(b)): n for n, (a, b) in enumerate(pairs)}
        self.whole: frozenset[str] = frozenset(self._proven(spec["model"]["vocab"], back))
        self.counts = Remembered(self._count_piece, CACHE_ENTRIES, CACHE_CHARS)

    def _count_piece(self, piece: str) -> int:
        return 1 if piece in self.whole else self.merge(piece.encode())

    def _proven(self, vocabulary: dict, back: dict[str, int]) -> Iterator[str]:
        for shown in vocabulary:
            if all(c in back for c in shown):
                data = bytes(back[c] for c in shown)
                try:
                    text = data.decode()
                except UnicodeDecodeError:
                    continue
                if self.merge(data) == 1:
                    yield text

    def merge(self, data: bytes) -> int:
        """The number of tokens of a pre-token: merge the pair of lowest rank everywhere, until none is left."""
        rank, parts = self.rank, [data[i : i + 1] for i in range(len(data))]
        if len(parts) > 256:
            return self._merge_long(parts)
        none = len(rank)
        found = [rank.get(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
        while found and (best := min(found)) != none:
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = rank.get((parts[i], parts[i + 1]), none)
        return len(parts)

    def _merge_long(self, parts: list[bytes]) -> int:
        """The same by a heap over a linked list: n log n for very long pre-tokens."""
        import heapq

        n, rank = len(parts), self.rank
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            count -= 1
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return count

    def count(self, text: str) -> int:
        if self.special and (found := self.special.findall(text)):
            return len(found) + sum(self.count_plain(t) for t in self.special.split(text))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.split_text(text)))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    with open(path, encoding="utf-8") as f:
        return Counter(json.load(f))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            sizes, counts = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                sizes.append(len(t.encode()))
                counts.append(c.count(t))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
