"""Language identification by bit-sliced Bloom filters of character n-grams.

A slot of the filter holds one bit for each language; the bitwise AND of an n-gram's slots is the set of all languages that contain it. A text's n-grams
are counted for each language, the counts corrected for the share of absent n-grams that the language's bits let through by chance,
c' = (c - n p) / (1 - p), and the language with the greatest corrected count is predicted (of equal ones the first by name). The score is that
count as a share of the text's n-grams.

The filters are learned from a bounded sample of labelled texts: ``PER_LANGUAGE`` documents of each language, ``SAMPLE`` in all, the first ``LONGEST`` characters of each and about
``CHARS`` characters in all, drawn by a hash of id and text; of the ``MOST_LANGUAGES`` languages with the most rows. Predictions read whole texts of any length. An n-gram
enters a language's filter if it was seen at least ``least_seen`` times there, and at least ``share`` as often (per n-gram read) as in
the language where it is most frequent; so foreign words and wrong labels in a sample do not spread. N-grams are lower-cased letters with
one space for each run of other characters.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything where no label was given to learn from (``keep_known`` then keeps all rows, having
nothing to judge by); nulls in the label leave a row out of the sample only; repeated rows are each predicted; an empty table gives an empty result; extra columns are ignored by
``predict`` and carried by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm._common import small_batches, table

N = 4
#: The sample to learn from: documents of each language, of all together, characters of a document in it, and of all together.
PER_LANGUAGE, SAMPLE, LONGEST, CHARS = 1500, 12_000, 20_000, 60_000_000
LEAST_SEEN = 2
SHARE = 0.25
#: Slots of the filter, and slots for each n-gram. A slot has as many words of 64 bits as its languages need.
SLOTS, HASHES = 1 << 20, 3
#: Distinct labels to learn at most, which bounds the filter to 64 MB.
MOST_LANGUAGES = 512
UNKNOWN = "und"
#: Below this score the pipeline does not take a text for any known language.
LEAST_SCORE, LEAST_GRAMS = 0.35, 20

_LETTER = np.zeros(1 << 16, bool)
_LETTER[[c for c in range(1 << 16) if chr(c).isalpha()]] = True


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts, and where each text's begin (one more entry than texts)."""
    lowered = [f" {t.lower()} " if t else "" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    letter = np.where(codes < 1 << 16, _LETTER[np.minimum(codes, (1 << 16) - 1)], True)
    if (rare := np.flatnonzero(codes >= 1 << 16)).size:
        letter[rare] = [chr(c).isalpha() for c in codes[rare]]
    first = np.zeros(codes.size + 1, bool)
    first[begins] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a run of other characters leaves one space
    keep |= first[:-1]
    at = np.concatenate(([0], np.cumsum(keep)))
    begins = at[begins]
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    size = max(0, c.size - N + 1)
    h = np.zeros(size, np.uint64)
    for k in range(N):
        h = (h ^ c[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    # n-grams over the end of a text belong to none
    inside = np.ones(size, bool)
    for k in range(1, N):
        cuts = begins[1:-1] - k
        inside[cuts[(cuts >= 0) & (cuts < size)]] = False
    counts = np.concatenate(([0], np.cumsum(inside)))
    return h[inside], counts[np.minimum(begins, size)]


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # words by slots; bit k % 64 of word k // 64 is language k
    wrong: list[float]  # chance of a false positive, by language

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The set of languages that contain each n-gram: as many words as a slot has, by n-grams."""
        return reduce(np.bitwise_and, (self.slots[:, p] for p in _places(h, self.slots.shape[1])))

    def _scored(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Place of the best language, score, number of n-grams, and whether there is a letter, of each text."""
        h, begins = grams(texts)
        n = np.diff(begins)
        found = self.masks(h)
        best, which = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        for k, p in enumerate(self.wrong):
            hits = np.concatenate(([0], np.cumsum(_bit(found, k), dtype=np.int64)))
            right = (hits[begins[1:]] - hits[begins[:-1]] - n * p) / max(1 - p, 1e-9)
            better = right > best
            best[better], which[better] = right[better], k
        return which, np.clip(best / np.maximum(n, 1), 0, 1), n, [bool(t) and any(c.isalpha() for c in t) for t in texts]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        which, score, _, letters = self._scored(texts)
        return [(self.languages[k], float(s)) if ok else (UNKNOWN, 0.0) for k, s, ok in zip(which, score, letters, strict=True)]

    def known(self, texts: list[str | None], least_score: float) -> list[bool]:
        """Whether each text is taken for one of the languages. Texts of less than ``LEAST_GRAMS`` n-grams have too little to reject them by, as has every text without labels."""
        if not self.languages:
            return [True] * len(texts)
        _, score, n, letters = self._scored(texts)
        return [ok and (m < LEAST_GRAMS or s >= least_score) for s, m, ok in zip(score.tolist(), n.tolist(), letters, strict=True)]


def _places(h: np.ndarray, slots: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


def _bit(words: np.ndarray, k: int) -> np.ndarray:
    """Bit k of each slot or n-gram."""
    row = words[k // 64]
    return row >> row.dtype.type(k % 64) & row.dtype.type(1)


def learn(samples: dict[str, list[str]], slots: int = SLOTS, least_seen: int = LEAST_SEEN, share: float = SHARE) -> Filters:
    """Filters of the given texts of each language."""
    names = sorted(samples)
    kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(names) <= bits), np.uint64)
    seen = [np.unique(grams(samples[x])[0], return_counts=True) for x in names]
    rates = [n / max(1, n.sum()) for _, n in seen]
    every, at = np.unique(np.concatenate([g for g, _ in seen] or [np.zeros(0, np.uint64)]), return_inverse=True)
    top = np.zeros(every.size)
    np.maximum.at(top, at, np.concatenate(rates or [np.zeros(0)]))
    filters, a = np.zeros((-(-len(names) // 64) or 1, slots), kind), 0
    for k, ((g, n), r) in enumerate(zip(seen, rates, strict=True)):
        own = g[(n >= least_seen) & (r >= share * top[at[a : a + g.size]])]
        a += g.size
        for p in _places(own, slots):
            filters[k // 64, p] |= kind(1 << k % 64)
    return Filters(names, filters, [float(_bit(filters, k).mean()) ** HASHES for k in range(len(names))])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text has remainder 2 by 4."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, slots: int = SLOTS) -> Filters:
    """Filters of at most ``per_language`` labelled documents of each language, drawn by a hash of id and text among those that are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    known = known.select("doc_id", "lang", F.left("text", F.lit(LONGEST)).alias("text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return Filters([], np.zeros((1, slots), np.uint8), [])
    per_language, chars = max(1, min(per_language, SAMPLE // len(sizes))), CHARS / len(sizes)
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 30))
    shares = {r["lang"]: min(1.0, 0.9 * per_language / r["n"] if r["n"] > per_language else 1.0, chars / max(1, r["chars"])) for r in sizes}
    below = F.coalesce(*(F.when(F.col("lang") == x, F.lit(int(share * (1 << 30)) or 1)) for x, share in shares.items()), F.lit(-1))
    samples: dict[str, list[str]] = {x: [] for x in shares}
    # about per_language texts of each language; the limit holds where one row is repeated very often
    for r in sorted(known.filter(place < below).select(place.alias("k"), "lang", "text").limit(2 * per_language * len(sizes)).collect()):
        if len(samples[r["lang"]]) < per_language:
            samples[r["lang"]].append(r["text"])
    return learn({x: t for x, t in samples.items() if t}, slots)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` (doc_id and text of them) with ``lang_pred`` and ``score``: doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    shared, kind = docs.sparkSession.sparkContext.broadcast(filters), docs.schema["doc_id"].dataType
    of_id = to_arrow_type(kind)

    def of_batch(batches):
        for b in batches:
            texts, said = b.column(1).to_pylist(), []
            a = size = 0
            for k, t in enumerate(texts, 1):  # numpy's arrays stay small whatever the texts' length
                size += len(t or "")
                if size > 1 << 20 or k == len(texts):
                    said += shared.value.predict(texts[a:k])
                    a, size = k, 0
            yield pa.RecordBatch.from_arrays([b.column(0).cast(of_id), pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(of_batch, f"doc_id {kind.simpleString()}, lang_pred string, score double")


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text is in a known language, with all their columns as they were."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema

    shared, schema = docs.sparkSession.sparkContext.broadcast(fit(docs)), to_arrow_schema(docs.schema)
    at = docs.columns.index("text")

    def of_batch(batches):
        for b in batches:
            texts, good = b.column(at).to_pylist(), []
            a = size = 0
            for k, t in enumerate(texts, 1):
                size += len(t or "")
                if size > 1 << 20 or k == len(texts):
                    good += shared.value.known(texts[a:k], least_score)
                    a, size = k, 0
            yield b.filter(pa.array(good, pa.bool_())).cast(schema)

    return docs.mapInArrow(of_batch, docs.schema)


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = predict(docs, fit(docs))
    return said.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
