"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of its bytes up to three back, with how often every byte followed. A byte costs what its
longest seen context says; where it never followed, the cost of an escape is added and the next shorter context
is asked, down to all bytes alike. Statistics are frozen after training, so the exact code length of a text is a sum over its
four-byte strings; a string's length is looked up where it has been worked out before. The shortest code names the language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents per language that a model is trained on: those with the smallest hash, whole texts each.
SAMPLE_DOCS = 150
#: Longer texts are trained on only where a language has too few others.
TEXT_BYTES = 1 << 20
#: Parts in which a language's smallest hashes are found before they are compared.
PARTS = 64
CONTEXT = 3
#: What stands before a text.
PAD = b"\n" * CONTEXT
UNKNOWN = "und"
#: Bytes of a worker's table of lengths, whatever the number of languages.
TABLE_BYTES = 64 << 20
#: Lengths are counted in parts of a bit.
UNIT = 1 << 16
SPREAD = np.uint32(0x9E3779B1)


Model = dict[str, tuple[np.ndarray, np.ndarray]]


def _strings(text: bytes) -> np.ndarray:
    """Every byte from the fourth on with the three before it, as one number."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    return data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]


@dataclass
class Level:
    """One depth of a tree: contexts with the bytes that followed."""

    symbols: np.ndarray
    times: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray


class ContextTree:
    def __init__(self, grams: np.ndarray, times: np.ndarray) -> None:
        self.levels = []
        for depth in range(CONTEXT, -1, -1):
            symbols, place = np.unique(grams & np.uint32((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            n = np.bincount(place, weights=times, minlength=len(symbols))
            contexts, place = np.unique(symbols >> np.uint32(8), return_inverse=True)
            totals = np.bincount(place, weights=n, minlength=len(contexts))
            self.levels.append(Level(symbols, n, contexts, totals, np.bincount(place, minlength=len(contexts)).astype(float)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of every gram after the others."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        for depth, level in zip(range(CONTEXT, -1, -1), self.levels):
            symbol = grams[todo] & np.uint32((1 << 8 * (depth + 1)) - 1)
            known, at = _find(level.contexts, symbol >> np.uint32(8))
            total, kinds = level.totals[at], level.kinds[at]
            followed, where = _find(level.symbols, symbol)
            chance = np.where(followed, level.times[where], kinds) / (total + kinds)
            # a context that was never seen costs nothing to leave
            out[todo] -= np.where(known, np.log2(chance), 0.0)
            todo = todo[~followed]
        out[todo] += 8.0
        return out


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted, at


class Scorer:
    """Code lengths of texts under every language.

    Lengths of strings met so far lie in a table of fixed size, where a string has two places and newer ones push out older ones. They
    are whole numbers of 2^-16 bits, so a sum is the same whatever the table held, and equal lengths are equal.
    """

    def __init__(self, model: Model) -> None:
        self.languages = sorted(model)
        self.trees = [ContextTree(*model[name]) for name in self.languages]
        n = len(self.trees)
        places = 1 << ((TABLE_BYTES // (4 + 4 * n)).bit_length() - 1)
        self.shift = np.uint32(33 - places.bit_length())
        self.keys = np.zeros(places, np.uint32)
        self.lengths = np.zeros((places, n), np.int32)
        # an empty place reads as the string of four zero bytes, whose two places are the first
        self.lengths[:2] = self._of(np.zeros(1, np.uint32))
        self.chunk = max(1 << 12, min(1 << 20, (1 << 22) // n))

    def _of(self, grams: np.ndarray) -> np.ndarray:
        return np.stack([np.rint(tree.bits(grams) * UNIT) for tree in self.trees], axis=1).astype(np.int32)

    def units(self, text: bytes) -> np.ndarray:
        """Code length of a whole text by language, in units of 2^-16 bits."""
        whole = np.zeros(len(self.trees), np.int64)
        data = PAD + text
        for at in range(0, len(text), self.chunk):
            grams = _strings(data[at : at + self.chunk + CONTEXT])
            places = (grams * SPREAD) >> self.shift
            known = self.keys.take(places) == grams
            if not known.all():
                other = np.where(known, places, places ^ np.uint32(1))
                known = self.keys.take(other) == grams
                places = other
            if not known.all():
                new, times = np.unique(grams[~known], return_counts=True)
                lengths = self._of(new)
                whole += times @ lengths.astype(np.int64)
                places = places[known]
            whole += self.lengths.take(places, axis=0).sum(axis=0, dtype=np.int64)
            if len(places) < len(grams):
                self._keep(new, lengths)
        return whole

    def _keep(self, grams: np.ndarray, lengths: np.ndarray) -> None:
        places = (grams * SPREAD) >> self.shift
        places = np.where(self.keys[places] == 0, places, places ^ np.uint32(1))
        # of several for one place the last stays, in both arrays
        places, last = np.unique(places[::-1], return_index=True)
        self.keys[places], self.lengths[places] = grams[::-1][last], lengths[::-1][last]

    def predict(self, text: str) -> tuple[str, float]:
        """The language with the shortest code, the first by name if several are, and its share under equal odds."""
        lengths = self.units(text.encode())
        best = int(np.argmin(lengths))
        return self.languages[best], float(1.0 / np.exp2((lengths[best] - lengths) / UNIT).sum())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of each text with their numbers, one text at a time."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            grams, times = np.unique(_strings(PAD + text.as_py().encode()), return_counts=True)
            columns = [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "times"])


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text_bytes: int = TEXT_BYTES) -> Model:
    """Counts of four-byte strings by language, from ``docs(text, lang)``; rows without text or lang are left out.

    Each language has the ``sample_docs`` distinct texts with the smallest hash, so a source with a third of all rows weighs no more than its
    share. Texts of more than ``text_bytes`` bytes are taken, whole, only where a language has too few others. Strings are
    counted one text at a time and summed by Spark; only the sums, at most as many as the sample has bytes, pass the driver.
    """
    known = docs.where("text is not null and lang is not null").select(
        "lang", "text", (F.octet_length("text") > text_bytes).alias("long"), F.xxhash64("lang", "text").alias("mark")
    )
    marks = known.select("lang", "long", "mark").distinct().withColumn("part", F.spark_partition_id() % PARTS)
    # first the smallest of every part, then of a language's at most PARTS * sample_docs: a hot language is no task of its own
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("long", "mark")
        marks = marks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample_docs)
    sample = known.join(marks.select("lang", "mark"), ["lang", "mark"], "left_semi").dropDuplicates(["lang", "mark"])
    strings = sample.select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, times bigint")
    summed = strings.groupBy("lang", "gram").agg(F.sum("times").alias("times")).toArrow()
    summed = summed.sort_by([("lang", "ascending"), ("gram", "ascending")])
    names, first = np.unique(np.array(summed.column("lang").to_pylist(), object), return_index=True)
    grams, times = summed.column("gram").to_numpy().astype(np.uint32), summed.column("times").to_numpy()
    return dict(zip(names.tolist(), zip(np.split(grams, first[1:]), np.split(times, first[1:]))))


def _digest(model: Model) -> str:
    """Name of a model by what it holds."""
    mark = hashlib.sha256()
    for name in sorted(model):
        grams, times = model[name]
        for part in (name.encode(), grams.astype("<u4").tobytes(), times.astype("<i8").tobytes()):
            mark.update(len(part).to_bytes(8, "little") + part)
    return mark.hexdigest()


#: The scorer that a worker last used, under its model's name.
_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang_pred`` and ``score`` (0 to 1), from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0; so is every text under a model without languages. A text
    of any length is scored in parts of bounded size. Of languages with equal lengths the first by name is named.
    """
    sent, name = docs.sparkSession.sparkContext.broadcast(model), _digest(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value and name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(sent.value)
        scorer = _scorers.get(name)
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field(rows.type.get_field_index("text"))
            found = [scorer.predict(t.as_py()) if has and scorer else (UNKNOWN, 0.0) for t, has in zip(texts, batch.column(1).to_pylist())]
            names, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([rows, pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("has_letter"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for documents that are kept from training: crc32 of the id's digits leaves no remainder. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
