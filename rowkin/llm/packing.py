"""Packing of documents into token windows: bounded-space online best fit.

Every partition keeps a fixed number of open windows. A document longer than a window first fills whole windows; what remains goes into the open
window with the least room that suffices, else into a new one, and where all are open and none fits the fullest is emitted. At the end of the
partition the open windows, a fixed number of them, travel with their ids to a merge that fills windows from those of 8 partitions, cutting a
piece at the end of a window; so padding is left in emitted windows (a few ids) and in one window for each merge. No task holds more than the
open windows of its partition, or of the 8 that it merges, besides one document.

Defined cases: a null or empty text is the separator alone; a null or repeated id is carried as it is; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm._common import cut, small_batches, table
from rowkin.llm.pretokens import is_plain, pretokens

WINDOW = 1024
OPEN = 64
#: Partitions whose open windows are merged in one task.
FAN_IN = 8
#: Pre-tokens that a worker remembers at most.
REMEMBERED = 300_000
_PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder(dict):
    """Ids of a text by the vocabulary file, each as four little-endian bytes.

    Pre-tokens are encoded once and remembered. Texts with uncommon characters, or that spell a special token, go through the tokenizers library as
    a whole; for the others the ranks of the same vocabulary give the same ids faster.
    """

    def __init__(self, vocabulary: str, ranks: str):
        super().__init__()
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})._encode_single_piece  # a pre-token is not split again: very long ones overflow its pattern

    def __missing__(self, piece: str) -> bytes:
        ids = self.part(piece.encode("utf-8", "replace"))
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 32 and len(self) < REMEMBERED:  # the first to come are the frequent ones
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if is_plain(text) and not any(s in text for s in self.special):
            return b"".join([self[p] for p in pretokens(text)])
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(2)
def shared(vocabulary: str, ranks: str) -> Encoder:
    """One encoder for each Python worker, which keeps what it remembers over its tasks."""
    return Encoder(vocabulary, ranks)


class Packer:
    """The open windows of one partition. ``add`` returns the pieces of windows that are complete, ``close`` those of the open ones."""

    def __init__(self, window: int = WINDOW, most: int = OPEN, first: int = 0):
        self.window, self.most, self.next = window, most, first
        self.rooms: list[tuple[int, int]] = []  # (room, sequence) in order
        self.held: dict[int, list[tuple]] = {}

    def add(self, doc, ids: bytes) -> list[tuple]:
        """Pieces are (doc, start, length, crc32, the document's ids, sequence, offset, ids)."""
        n, size, out = len(ids) // 4, self.window, []
        for a in range(0, n - size + 1, size):
            part = ids[4 * a : 4 * (a + size)]
            out.append((doc, a, size, zlib.crc32(part), n, self.next, 0, None))
            self.next += 1
        if left := n % size:
            part = ids[4 * (n - left) :]
            at = bisect_left(self.rooms, (left, -1))
            if at < len(self.rooms):
                room, sequence = self.rooms.pop(at)
            else:
                if len(self.rooms) >= self.most:
                    out += self.held.pop(self.rooms.pop(0)[1])
                room, sequence = size, self.next
                self.next += 1
                self.held[sequence] = []
            self.held[sequence].append((doc, n - left, left, zlib.crc32(part), n, sequence, size - room, part))
            if room > left:
                insort(self.rooms, (room - left, sequence))
            else:
                out += self.held.pop(sequence)
        return [(*p[:7], None) for p in out]

    def close(self) -> list[tuple]:
        return [p for pieces in self.held.values() for p in pieces]


def merged(pieces: Iterator[tuple], window: int, first: int) -> Iterator[tuple]:
    """Pieces (doc, start, doc_tokens, ids) laid one behind the other into windows, cut where a window ends."""
    sequence, offset = first, 0
    for doc, start, total, ids in pieces:
        while ids:
            part = ids[: 4 * (window - offset)]
            yield doc, start, len(part) // 4, zlib.crc32(part), total, sequence, offset
            ids, start, offset = ids[len(part) :], start + len(part) // 4, offset + len(part) // 4
            if offset == window:
                sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, window: int = WINDOW, most_open: int = OPEN, vocabulary: str | None = None, ranks: str | None = None, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    files = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = struct.pack("<I", separator)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema["doc_id"].dataType), *[pa.int64()] * 6]

    def of_partition(batches):
        encoder, part = shared(*files), TaskContext.get().partitionId()
        packer, rows = Packer(window, most_open, part << 32), []

        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 8
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=False)), pa.array(columns[7], pa.binary()), pa.array([part] * len(rows), pa.int64())], [*names, "ids", "part"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += packer.add(doc, encoder.encode(text or "") + end)
            if len(rows) >= 2000:
                yield batch(rows)
                rows = []
        yield batch(rows + packer.close())

    def of_group(group: pa.Table) -> pa.Table:
        held = sorted(zip(*(group.column(c).to_pylist() for c in ("sequence_id", "offset", "start", "doc_id", "doc_tokens", "ids", "part")), strict=True), key=lambda r: r[:3])
        rows = list(merged(((r[3], r[2], r[4], r[5]) for r in held), window, (1 << 62) + (held[0][6] // FAN_IN << 32)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    pieces = _PIECES.format(id=kind)
    placed = cut(docs.select("doc_id", "text").mapInArrow(of_partition, f"{pieces}, ids binary, part long"))
    late = placed.filter("ids IS NOT NULL").groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(of_group, pieces)
    return placed.filter("ids IS NULL").select(*names).unionByName(late)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
