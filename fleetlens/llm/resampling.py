"""Resampling towards a target distribution, with exact importance weights from bit-sliced aggregation.

Runs of words are hashed to buckets. A bucket's gain is the log ratio of its share in the target texts to its
share in the documents, as a whole number of thousandths; a document's weight is the mean gain of its features. Gains are
the same for all documents, so they are cut once into bit planes: plane k holds bit k of every bucket's gain, the last one
the sign. A document's bucket counts are cut into planes the same way. The sum of gains is then a sum over pairs of planes:

    sum of counts * gains = sum over j, k of  2**j * (+-2**k) * popcount(counts' plane j AND gains' plane k)

which is whole-number arithmetic, so weights are exact whatever the order of the words. A Gumbel score from a hash of the doc_id
is added to the weight, and the documents with the highest scores are drawn: sampling without replacement that a rerun repeats.

Bucket totals are summed per task and shuffled as at most one row per task and bucket. Ranks need no global sort: scores are
whole numbers of a proven range, so one small table of counts per score gives every score its first rank, and rows
are put in order only within a score.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin

BUCKETS = 10_000
#: Documents whose planes are held together.
PLANE_ROWS = 128

#: Bytes of words: digits, letters (put in lower case) and all of characters past ASCII; other bytes become spaces.
LOWER = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def features(text: bytes, runs: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to ``runs`` consecutive words, repeats included."""
    words = text.translate(LOWER).split()
    found = [np.fromiter(map(zlib.crc32, words), np.int64, len(words))]
    for n in range(2, runs + 1):
        joined = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        found.append(np.fromiter(map(zlib.crc32, joined), np.int64, len(joined)))
    return np.concatenate(found) % buckets


def n_words(text: bytes) -> int:
    return len(text.translate(LOWER).split())


def _texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, null as empty."""
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def bucket_totals(docs: DataFrame, runs: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket: an array of ``buckets`` numbers, whatever the number of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                total += np.bincount(features(text, runs, buckets), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():
        total[bucket] = n
    return total


def gains(docs_totals: np.ndarray, target_totals: np.ndarray) -> list[int]:
    """Gain of each bucket, in thousandths, with every count one larger than it is."""
    buckets = len(docs_totals)
    all_docs, all_target = float(docs_totals.sum() + buckets), float(target_totals.sum() + buckets)
    return [
        math.floor(1000 * math.log(float(t + 1) * all_docs / (float(s + 1) * all_target)))
        for s, t in zip(docs_totals.tolist(), target_totals.tolist())
    ]


def planes(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of rows of whole numbers: ``out[row, bit]`` holds that bit of each number, 64 of them to a word."""
    rows, width = numbers.shape
    out = np.zeros((rows, bits, -(-width // 64) * 8), np.uint8)
    for bit in range(bits):
        out[:, bit, : -(-width // 8)] = np.packbits(numbers >> bit & 1, axis=1, bitorder="little")
    return out.view(np.uint64)


@dataclass
class SlicedGains:
    """Gains in two's complement, a plane per bit; the last plane counts negative."""

    planes: np.ndarray
    bits: int

    @classmethod
    def of(cls, numbers: list[int]) -> SlicedGains:
        bits = max(max(n, ~n).bit_length() for n in numbers) + 1
        return cls(planes(np.array([numbers], np.int64), bits)[0], bits)

    def sums(self, counts: np.ndarray) -> list[int]:
        """Sum of counts * gains for each row of bucket counts, from intersections of planes alone."""
        n_bits = int(counts.max(initial=0)).bit_length()
        own = planes(counts, n_bits)
        out = [0] * len(counts)
        for j in range(n_bits):
            for k in range(self.bits):
                both = np.bitwise_count(own[:, j] & self.planes[k]).sum(axis=1, dtype=np.int64)
                worth = -(1 << j + k) if k == self.bits - 1 else 1 << j + k
                out = [had + worth * n for had, n in zip(out, both.tolist())]
        return out


def gumbel(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel number that depends on the seed and the doc_id alone (null as an empty name)."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, numbers: list[int], runs: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for every row of ``docs(doc_id, text, ...)`` under the gains of buckets.

    ``weight`` is the floored mean gain of a document's features, 0 without any; ``score`` adds the document's Gumbel number.
    """
    buckets = len(numbers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SlicedGains.of(numbers)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
            for at in range(0, len(ids), PLANE_ROWS):
                some = ids[at : at + PLANE_ROWS]
                counts, words, n = np.zeros((len(some), buckets), np.int32), [], []
                for place, text in zip(range(len(some)), texts):
                    found = features(text, runs, buckets)
                    counts[place] = np.bincount(found, minlength=buckets)
                    n.append(len(found))
                    words.append(len(found) if runs == 1 else n_words(text))
                weights = [s // m if m else 0 for s, m in zip(own.sums(counts), n)]
                scores = [w + gumbel(i, seed) for i, w in zip(some, weights)]
                columns = [some, words, n, weights, scores]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(work, ", ".join(f"{c} bigint" for c in names))


def draw(scored: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the ``percent`` of rows of at least ``min_words`` words with the highest scores.

    Ties go to the smaller doc_id (null first), then to more features. Other rows have no rank.

    The scores of a table take few values (a Gumbel number has 26,008, a weight at most the range of the gains), and the
    hash of the doc_id spreads even equal texts over them, so the counts per score are a small table and no score holds many rows.
    """
    rows = pin(scored)
    fit = rows.where(F.col("n_words") >= min_words)
    per_score = fit.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    wanted = percent * sum(r["n"] for r in per_score) // 100
    firsts, before = [], 0
    for score, n in per_score:
        if before >= wanted:
            break
        firsts.append((score, before))
        before += n
    session = scored.sparkSession
    # a bounded table: one row per value of a score
    starts = F.broadcast(session.createDataFrame(firsts, "score bigint, before bigint"))
    inside = Window.partitionBy("score").orderBy("doc_id", F.desc("n_features"), F.desc("weight"))
    high = fit.join(starts, "score").withColumn("rank", F.col("before") + F.row_number().over(inside))
    drawn = high.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    last = firsts[-1][0] if firsts else None
    low = rows if last is None else rows.where((F.col("n_words") < min_words) | (F.col("score") < last))
    return drawn.unionByName(low.select(*scored.columns, F.lit(None).cast("bigint").alias("rank")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    runs: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs(doc_id, text, ...)``.

    Documents are drawn so that their words come to look like those of ``target(text, ...)``. Words are runs of digits,
    letters and characters past ASCII, A-Z in lower case; a null or empty text has none and weight 0. Texts of any length are
    counted whole. A repeated row is drawn or left out like any other, ranked beside its copy. A null doc_id is hashed as an
    empty name. An empty table of documents gives none; an empty target makes rare words gain. Columns beside doc_id and
    text are not read, whatever their names.
    """
    if percent < 0 or percent > 100 or runs < 1 or buckets < 1:
        raise ValueError("percent must be 0 to 100, runs and buckets 1 at least")
    numbers = gains(bucket_totals(docs, runs, buckets), bucket_totals(target, runs, buckets))
    return draw(weigh(docs, numbers, runs, seed), percent, min_words)
