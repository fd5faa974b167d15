"""Periodic runs of words inside documents, by seeds on diagonals that are extended.

A run of period q is a stretch of words in which words q apart are identical: on the diagonal of lag q it is a stretch of
matches, q shorter than the run. Lags are taken in classes of lo <= q < 2 * lo. A run that counts matches over at least

    M = least of max(least_words - q, (periods - 1) * q) over the lags of the class

words, so a phrase of k words that starts at a multiple of t, with k + t - 1 <= M, lies in it whole: the overlap that is guaranteed.
For each class, in the order of lags:

1. index: the hashes of all k-word phrases, sorted with their places,
2. seeds: for each phrase at a multiple of t, its later occurrences in the same document at a lag of the class; at most
   n / t * lo of them, which is about 2 n, even if all words are equal,
3. seeds below the furthest place that a shorter period has covered on their lag are dropped (a run of period p covers the lags
   2 p, 3 p, ...), in one search over the table of covered places,
4. of the rest, the first seed on its lag beyond what has been covered is extended word by word to both ends; the
   table moves on to the end of the stretch.

A stretch whose period is a multiple of a smaller one is always covered by step 3, so what is left are the runs with their
smallest periods. Work and memory grow with n log n of a document; documents are handled in batches of bounded length, as
one sequence with separators that equal nothing. Hashes only choose seeds; every run is proven by the words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shortest run in words, and how often its period must fit in it.
LEAST_WORDS = 12
PERIODS = 2
#: Words of the documents that are handled together; a longer document is handled alone.
BATCH_WORDS = 1 << 16
MULTIPLIER = 0x9E3779B97F4A7C15


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def phrase_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from every place on, built by doubling."""
    power, have, run, out, n = MULTIPLIER, 1, words, None, 0
    while True:
        if k & have:
            if out is None:
                out, n = run, have
            else:
                size = len(words) - n - have + 1
                out, n = out[:size] * np.uint64(power) + run[n : n + size], n + have
        have *= 2
        if have > k:
            return _mix(out)
        half = have // 2
        run = run[: len(run) - half] * np.uint64(power) + run[half:]
        power = power * power % (1 << 64)


class Covered:
    """Per lag, the places from which a stretch of matches is known, and how far."""

    def __init__(self, size: int) -> None:
        self.size = np.int64(size + 1)
        self.lags: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, start: int, length: int, period: int) -> None:
        """The run covers the diagonals of all multiples of its period."""
        lags = np.arange(2 * period, length, period, dtype=np.int64)
        if len(lags):
            self.lags.append(lags)
            self.starts.append(np.full(len(lags), start, np.int64))
            self.ends.append(start + length - lags)

    def open(self, lags: np.ndarray, places: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Which places on their lags (all in lo to hi) no stretch covers."""
        if not self.lags:
            return np.ones(len(places), bool)
        all_lags, starts, ends = (np.concatenate(part) for part in (self.lags, self.starts, self.ends))
        # entries below the class are not asked for again
        later = all_lags >= lo
        all_lags, starts, ends = all_lags[later], starts[later], ends[later]
        self.lags, self.starts, self.ends = [all_lags], [starts], [ends]
        now = all_lags < hi
        order = np.lexsort((starts[now], all_lags[now]))
        key = (all_lags[now] * self.size + starts[now])[order]
        if not len(key):
            return np.ones(len(places), bool)
        furthest = np.maximum.accumulate((all_lags[now] * self.size + ends[now])[order])
        asked = lags * self.size + places
        at = np.searchsorted(key, asked, "right") - 1
        return (at < 0) | (furthest[at] <= asked)


def _stretch(words: np.ndarray, place: int, lag: int, k: int) -> tuple[int, int] | None:
    """The stretch of matches on the lag around the ``k`` words at ``place``; None if they do not all match."""
    n = len(words) - lag
    if not np.array_equal(words[place : place + k], words[place + lag : place + lag + k]):
        return None
    end, step = place + k, 64
    while end < n:
        stop = min(n, end + step)
        differ = words[end:stop] != words[end + lag : stop + lag]
        first = int(differ.argmax())
        if differ[first]:
            end += first
            break
        end, step = stop, 2 * step
    start, step = place, 64
    while start > 0:
        stop = max(0, start - step)
        differ = (words[stop:start] != words[stop + lag : start + lag])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            start -= first
            break
        start, step = stop, 2 * step
    return start, end


def _classes(longest: int, least_words: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """Lags from, below, and the overlap that a run of the class guarantees."""
    lo = 1
    while periods * lo <= longest and least_words <= longest:
        overlap = min(max(least_words - q, (periods - 1) * q) for q in range(lo, min(2 * lo, lo + least_words + 1)))
        yield lo, 2 * lo, overlap
        lo *= 2


def runs_of(words: np.ndarray, documents: np.ndarray, least_words: int = LEAST_WORDS, periods: int = PERIODS) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, sorted, of a sequence of word numbers (uint64).

    ``documents`` numbers the document of every place; sequences of several documents must be parted by numbers that occur once.
    """
    n, found = len(words), []
    sizes = np.bincount(documents) if n else np.zeros(1, np.int64)
    covered = Covered(n)
    salt = _mix(documents.astype(np.uint64) + np.uint64(1))
    mixed = _mix(words * np.uint64(MULTIPLIER) + np.uint64(7))
    for lo, hi, overlap in _classes(int(sizes.max()), least_words, periods):
        step = max(1, overlap // 2)
        k = overlap - step + 1
        if lo + k > n:
            break
        hashes = phrase_hashes(mixed, k)
        hashes ^= salt[: len(hashes)]
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        if not same.any():
            continue
        group = np.concatenate(([0], np.cumsum(~same)))
        key = group * np.int64(2 * n) + order
        # anchors whose phrase occurs later too
        later = np.flatnonzero(same)
        anchors = later[order[later] % step == 0]
        first = np.searchsorted(key, key[anchors] + lo)
        last = np.searchsorted(key, key[anchors] + np.minimum(hi, n))
        many = last - first
        places = np.repeat(order[anchors], many)
        if not len(places):
            continue
        others = order[np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        lags = others - places
        free = covered.open(lags, places, lo, hi)
        places, lags = places[free], lags[free]
        turn = np.lexsort((places, lags))
        lag_now, furthest = -1, -1
        for place, lag in zip(places[turn].tolist(), lags[turn].tolist()):
            if lag != lag_now:
                lag_now, furthest = lag, -1
            if place < furthest:
                continue
            stretch = _stretch(words, place, lag, k)
            if stretch is None:
                continue
            start, furthest = stretch
            length = furthest - start + lag
            if length >= least_words and length >= periods * lag:
                found.append((start, length, lag))
                covered.add(start, length, lag)
    rows = np.array(found, np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def _groups(texts: Iterator[list[bytes]]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for words in texts:
        group.append(words)
        size += len(words) + 1
        if size >= BATCH_WORDS:
            yield group
            group, size = [], 0
    if group:
        yield group


def runs_of_documents(group: list[list[bytes]], least_words: int = LEAST_WORDS, periods: int = PERIODS) -> list[np.ndarray]:
    """For each list of words its runs, with places counted from its first word."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    sizes = np.array([len(words) for words in group], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    sequence = np.empty(begins[-1], np.uint64)
    for begin, words in zip(begins.tolist(), group):
        sequence[begin : begin + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    # what parts two documents equals nothing
    sequence[begins[1:] - 1] = len(numbers) + np.arange(len(group))
    documents = np.repeat(np.arange(len(group)), sizes + 1)
    runs = runs_of(sequence, documents, least_words, periods)
    cuts = np.searchsorted(runs[:, 0], begins)
    return [runs[a:b] - [begin, 0, 0] for a, b, begin in zip(cuts, cuts[1:], begins.tolist())]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)] if len(runs) else words


FIELDS = ["n_words", "runs", "runs_sha256", "collapsed_text", "collapsed_sha256"]
KINDS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, runs_sha256 string, collapsed_text string, collapsed_sha256 string"


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, periods: int = PERIODS, text: bool = True) -> DataFrame:
    """``doc_id, n_words, runs, runs_sha256, collapsed_text, collapsed_sha256`` for every row of ``docs(doc_id, text, ...)``.

    Words are runs of bytes other than space and tab to carriage return; a null or empty text has none, no runs and an
    empty collapsed text. ``runs`` are all stretches of at least ``least_words`` words and ``periods`` times their smallest period that
    cannot be made longer on either side, as ``start, length, period`` in words, sorted; runs of different
    periods may overlap. ``runs_sha256`` digests a line per run; ``collapsed_text`` (null unless ``text``) is what is left, joined by one space,
    when each run keeps its first period only. Documents are judged one by one: repeated rows give equal rows, and a null doc_id
    stays null. Long documents are handled whole, alone. Columns beside doc_id and text are not read, whatever their names.
    """
    if least_words < 2 or periods < 2:
        raise ValueError("a run has two words and two periods at least")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or b"").split() for t in batch.column(1).cast(pa.binary()))
            at = 0
            for group in _groups(texts):
                rows = []
                for words, runs in zip(group, runs_of_documents(group, least_words, periods)):
                    kept = b" ".join(collapse(words, runs))
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                    spans = [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]
                    digest = hashlib.sha256(kept).hexdigest()
                    rows.append((len(words), spans, hashlib.sha256(lines.encode()).hexdigest(), kept.decode() if text else None, digest))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), *arrays], ["doc_id", *FIELDS])
                at += len(group)

    span = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    kinds = [pa.int64(), pa.list_(span), pa.string(), pa.string(), pa.string()]
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(work, f"doc_id bigint, {KINDS}")


def longest(runs: Column) -> Column:
    """The run of greatest length, ties to the smallest start, then the smallest period; null without runs."""
    order = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return F.struct((-order["col2"]).alias("start"), order["length"].alias("length"), (-order["col3"]).alias("period"))


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where about every tenth document, chosen by its doc_id, ends in a periodic tail.

    With h the CRC-32 of the doc_id in decimals and g = h // 10, the documents with h % 10 = 0 are changed: of n words, each word from
    a = g % n on becomes word a + (i - a) % p, with p = 1 + (n - a) // (3 + g % 8). A null doc_id and a text without words change nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    chosen = F.when(h % 10 == 0, F.struct(words.alias("w"), F.floor(h / 10).alias("g")))
    n = F.nullif(F.size("chosen.w").cast("bigint"), F.lit(0))
    a = F.col("chosen.g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("chosen.g") % 8))
    some = docs.select("doc_id", "text", chosen.alias("chosen")).withColumn("tail", F.when(n.isNotNull(), F.struct(a.alias("a"), p.alias("p"))))
    turned = F.transform(
        "chosen.w",
        lambda w, i: F.when(i < F.col("tail.a"), w).otherwise(
            F.get("chosen.w", (F.col("tail.a") + (i - F.col("tail.a")) % F.col("tail.p")).cast("int"))
        ),
    )
    return some.select("doc_id", F.when(F.col("tail").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
