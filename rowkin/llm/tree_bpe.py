"""Byte-level BPE by monoid tree reduction.

The bytes of every pre-token that is no entry of the vocabulary are encoded as a tree: halved recursively down to leaves of ``LEAF`` bytes, then joined upwards. The join
re-encodes a window around the boundary, at first the last id of the left and the first of the right side, and doubles the window until it stands: the pairs of ids at its
edges must each be stable, that is, encoding the two ids' bytes together gives the two ids again. An id sequence of which every neighbouring pair is stable, and
every id is the encoding of its own bytes, is the encoding of the whole: merges are taken by rank and place, so the first merge to cross a boundary would also cross it in the
encoding of that pair alone. Where a window has grown over both sides the join is plain encoding, so the result is exact in any case. Leaves and windows are short and come
again and again, so a worker remembers their encodings.

A text is the concatenation of its pre-tokens' encodings, and decoding concatenates the ids' bytes up a tree of halves.

Defined cases: null and empty texts have no ids; repeated rows are each encoded; null ids are carried; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from rowkin.llm._common import small_batches, table
from rowkin.llm.pretokens import pretokens

#: Up to so many bytes are encoded directly, without halves.
LEAF = 4
#: Pre-tokens, pairs of ids, and leaves and windows that a worker remembers at most, of each.
REMEMBERED = 500_000


class Known(dict):
    """Results by pre-token, computed where they are missing. The first to come, which are the frequent ones, are remembered."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, piece: str):
        found = self.compute(piece)
        if len(piece) <= 32 and len(self) < REMEMBERED:
            self[piece] = found
        return found


class TreeBPE:
    def __init__(self, ranks_file: str, leaf: int = LEAF):
        with open(ranks_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.leaf = leaf
        self._pairs: dict[tuple[int, int], list[int]] = {}
        self._short: dict[bytes, list[int]] = {}
        self.known = Known(self.encode_piece)

    def merge(self, data: bytes) -> list[int]:
        """Plain encoding from single bytes: of neighbouring parts always the pair of the lowest rank is joined, of equal ones the first."""
        if len(data) > 256:
            return self._merge_long(data)
        ranks, none = self.ranks, 1 << 60
        parts = [data[k : k + 1] for k in range(len(data))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            k = pairs.index(low)
            new = parts[k] + parts.pop(k + 1)
            parts[k] = new
            del pairs[k]
            if k < len(pairs):
                pairs[k] = ranks.get(new + parts[k + 1], none)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + new, none)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs: time grows with n log n."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at k
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, to = heapq.heappop(heap)
            middle = end[k]
            if middle < 0 or middle >= n or end[middle] != to:
                continue  # one of its sides has changed
            end[k], end[middle] = to, -1
            if to < n:
                before[to] = k
                if (r := ranks.get(data[k : end[to]])) is not None:
                    heapq.heappush(heap, (r, k, end[to]))
            if k and (r := ranks.get(data[before[k] : to])) is not None:
                heapq.heappush(heap, (r, before[k], to))
        out, k = [], 0
        while k < n:
            out.append(ranks[data[k : end[k]]])
            k = end[k]
        return out

    def short(self, data: bytes) -> list[int]:
        """The encoding of a leaf or window; remembered up to 16 bytes."""
        found = self._short.get(data)
        if found is None:
            found = self.merge(data)
            if len(data) <= 16 and len(self._short) < REMEMBERED:
                self._short[data] = found
        return found

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of two ids' bytes together."""
        found = self._pairs.get((a, b))
        if found is None:
            found = self.merge(self.bytes_of[a] + self.bytes_of[b])
            if len(self._pairs) < REMEMBERED:
                self._pairs[a, b] = found
        return found

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of two ids, encoded together, are these two ids again."""
        return self.pair(a, b) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded sides together."""
        if not left or not right:
            return left + right
        middle, a, b, size = self.pair(left[-1], right[0]), len(left) - 1, 1, 1
        while not ((a == 0 or self.stable(left[a - 1], middle[0])) and (b == len(right) or self.stable(middle[-1], right[b]))):
            size *= 2
            a, b = max(0, len(left) - size), min(len(right), size)
            middle = self.short(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
        return left[:a] + middle + right[b:]

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.short(data)
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        """The ids of a pre-token, and the same as text. A pre-token that is an entry of the vocabulary is that entry."""
        data = piece.encode("utf-8", "replace")
        ids = (self.ranks[data],) if data in self.ranks else tuple(self.encode_bytes(data))
        return ids, ",".join(map(str, ids))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return [i for ids, _ in map(self.known.__getitem__, pretokens(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up a tree of halves."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(2)
def shared(ranks_file: str) -> TreeBPE:
    """One encoder for each Python worker, which keeps what it remembers over its tasks."""
    return TreeBPE(ranks_file)


def encode(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id, ids: the whole text's ids."""
    return _mapped(docs, ranks_file, "ids array<int>", [pa.list_(pa.int32())], lambda bpe, text: [bpe.encode(text)])


def decode(encoded: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id, data: the bytes of ``ids`` (null: none)."""
    return _mapped(encoded.select("doc_id", "ids"), ranks_file, "data binary", [pa.binary()], lambda bpe, ids: [bpe.decode(ids or [])], "ids")


def digests(docs: DataFrame, ranks_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded, in one pass."""

    def of_text(bpe: TreeBPE, text: str):
        pieces = list(map(bpe.known.__getitem__, pretokens(text)))
        ids = [i for p, _ in pieces for i in p]
        return len(ids), hashlib.sha256(",".join([x for _, x in pieces]).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(docs, ranks_file, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], of_text)


def _mapped(docs: DataFrame, ranks_file: str | None, columns: str, types: list[pa.DataType], of_text, source: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    file, kind = ranks_file or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), docs.schema["doc_id"].dataType
    of_id, names = to_arrow_type(kind), [c.split()[0] for c in columns.split(", ")]

    def of_batch(batches):
        bpe = shared(file)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # results of few texts at once
                part = b.slice(at, 64)
                rows = [of_text(bpe, x if x is not None else "" if source == "text" else None) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(of_id), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", *names])

    return docs.select("doc_id", source).mapInArrow(of_batch, f"doc_id {kind.simpleString()}, {columns}")


def op8_tree_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
