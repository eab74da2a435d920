"""Token counts of a unigram model by dynamic programming over a trie of pre-tokens.

Distinct pre-tokens are inserted in a trie. A node stands for a prefix and holds its forward score, the best total score of a segmentation of that prefix
into pieces, and that segmentation's number of pieces; it is computed once from the nodes above it, however many pre-tokens share the prefix. A
pre-token's count is read at its last node, a text's count is the sum over its pre-tokens.

Pieces come from a public vocabulary in order of rank; as unigram probabilities they get Zipf's law, p = 1 / ((rank + 1) H). A character that is no
piece counts as its UTF-8 bytes, each at the probability of the last rank. Pre-tokens are the runs of characters other than ASCII
white space, each with the vocabulary's word mark in front; white space itself counts nothing. Of equal scores the fewest pieces win.

Defined cases: null and empty texts count 0; null ids are carried; repeated rows are each counted; an empty table gives an empty result; extra columns are ignored.
A worker's trie holds at most ``NODES`` nodes, checked at each pre-token, and starts anew beyond. Pre-tokens of more than ``LONGEST`` characters, of
which hardly two share a prefix, run through the same recurrence over the last scores alone, as many as the longest piece has characters.
"""

from __future__ import annotations

import functools
import math
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from rowkin.llm._common import small_batches, table

MARK = "▁"
NODES = 600_000
#: Characters of a pre-token in the trie.
LONGEST = 256
#: Pre-tokens whose count a worker remembers at most.
REMEMBERED = 500_000
_WORDS = re.compile("[^\x20\x09-\x0d]+")


def pieces_of(model_file: str) -> list[str]:
    """The vocabulary's text pieces by rank: without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [model.id_to_piece(i) for i in sorted(own, key=lambda i: (-model.get_score(i), i))]


class Known(dict):
    """Counts by pre-token, read from the trie where they are missing. The first to come, which are the frequent ones, are remembered."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str) -> int:
        found = self.compute(word)
        if len(word) <= 32 and len(self) < REMEMBERED:
            self[word] = found
        return found


class Trie:
    def __init__(self, pieces: list[str], nodes: int = NODES):
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.score = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
        self.byte = -math.log(max(1, len(pieces))) - total
        #: Lengths of the pieces by their last two characters, ascending.
        self.sizes: dict[str, tuple[int, ...]] = {}
        for p in sorted(pieces, key=len):
            if len(p) > 1 and len(p) not in self.sizes.get(p[-2:], ()):
                self.sizes[p[-2:]] = (*self.sizes.get(p[-2:], ()), len(p))
        self.nodes = nodes
        self.most = max([1, *map(len, pieces)])
        self.known = Known(lambda w: self.tokens(MARK + w))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def last(self, word: str, depth: int, best: list[float], count: list[int], path) -> tuple[float, int]:
        """Score and count of the prefix of ``depth`` characters; ``path[d]`` is the place in ``best`` and ``count`` of the prefix of d characters."""
        c, up = word[depth - 1], path[depth - 1]
        s = self.score.get(c)
        if s is None:
            pieces = len(c.encode("utf-8", "replace"))
            top, pieces = best[up] + pieces * self.byte, count[up] + pieces
        else:
            top, pieces = best[up] + s, count[up] + 1
        for k in self.sizes.get(word[depth - 2 : depth], ()) if depth > 1 else ():
            if k > depth:
                break
            s = self.score.get(word[depth - k : depth])
            if s is not None:
                up = path[depth - k]
                s += best[up]
                if s > top or s == top and count[up] < pieces - 1:
                    top, pieces = s, count[up] + 1
        return top, pieces

    def tokens(self, word: str) -> int:
        """The number of pieces of the best segmentation of a pre-token."""
        if len(word) > LONGEST:
            return self.long(word)
        if len(self.best) + len(word) > self.nodes:
            self.clear()
        child, best, count, path, at = self.child, self.best, self.count, [0], 0
        for depth, c in enumerate(word, 1):
            key = at << 21 | ord(c)
            below = child.get(key)
            if below is None:
                top, pieces = self.last(word, depth, best, count, path)
                below = child[key] = len(best)
                best.append(top)
                count.append(pieces)
            path.append(below)
            at = below
        return count[at]

    def long(self, word: str) -> int:
        """The same without nodes: a ring of the last scores."""
        size = self.most + 1
        best, count, path = [0.0] * size, [0] * size, _Ring(size)
        for depth in range(1, len(word) + 1):
            best[depth % size], count[depth % size] = self.last(word, depth, best, count, path)
        return count[len(word) % size]

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text; pre-tokens that are not remembered are inserted, or found, in the trie."""
        words = (_WORDS.findall(t) if t else [] for t in texts)
        return [(sum(map(self.known.__getitem__, w)), len(w)) for w in words]


class _Ring:
    """Places of prefixes in a ring of scores."""

    def __init__(self, size: int):
        self.size = size

    def __getitem__(self, depth: int) -> int:
        return depth % self.size


@functools.lru_cache(2)
def shared(model_file: str) -> Trie:
    """One trie for each Python worker, kept over its tasks."""
    return Trie(pieces_of(model_file))


def token_counts(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_pretokens."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    file, kind = model_file or public_tokenizers.path("piece_bpe_32k.model"), docs.schema["doc_id"].dataType
    of_id = to_arrow_type(kind)

    def of_batch(batches):
        for b in batches:
            found = shared(file).counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(of_id), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], ["doc_id", "n_tokens", "n_pretokens"])

    return docs.select("doc_id", "text").mapInArrow(of_batch, f"doc_id {kind.simpleString()}, n_tokens long, n_pretokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
