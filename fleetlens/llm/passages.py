"""Removal of word passages that recur, located with sharded automata of confirmed passages.

A window of ``window`` consecutive words is represented by the smallest hash among its phrases of about half its
length. Two equal windows have the same smallest phrase, so only phrases that are found twice can lie in a
recurring window, and a text has about one such phrase for every nine words. The steps:

1. phrases: every text gives the smallest phrases of its windows; those found twice anywhere are kept,
2. partners: windows around such phrases are grouped by hash over all texts, and each text with a window that
   another place seems to have as well asks for the words of that place, by passage: a bounded stretch of the partner's text,
3. automata: texts are gathered to shards of bounded size; anchors, cut from the passages so that each window of a passage
   holds one, are compiled into one Aho-Corasick automaton that is streamed over the shard's texts,
4. confirmation: from every hit text and passage are compared word for word; a stretch of ``window`` equal words or
   more, at another place than its own, is removed.

Hashes only tell which passages to compare, so no word goes on the evidence of a hash. Each text is shuffled once. A task names
as partner what it has itself seen twice, so a passage that a third of all texts share sends two rows per task and has
a partner in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 35
#: Entries after which a task forgets what it has seen; more rows are then sent, with the same result.
REMEMBERED = 1 << 19
MULTIPLIER = 0x5851F42D4C957F2D


class WordHashes:
    """64-bit hashes of words, with a bounded memory of recent words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _joined(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, built by doubling."""
    power, width = np.uint64(MULTIPLIER), 1
    run, total, have = hashes, None, 0
    while True:
        if length & width:
            if total is None:
                total, have = run, width
            else:
                n = len(hashes) - have - width + 1
                total, have = total[:n] * power + run[have : have + n], have + width
        width *= 2
        if width > length:
            break
        run = run[: len(run) - width // 2] * power + run[width // 2 :]
        # without this step alternating words would cancel out
        run = run ^ (run >> np.uint64(32))
        power = np.uint64(int(power) * int(power) & (1 << 64) - 1)
    total = total ^ (total >> np.uint64(31))
    total = total * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def phrase_words(window: int) -> int:
    return (window + 1) // 2


def smallest_phrases(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every phrase, and the smallest in each window."""
    phrases = _joined(hashes, phrase_words(window))
    return phrases, _least(phrases, window - phrase_words(window) + 1)


class Seen:
    """Which of the values that a task meets it has itself met in two places before."""

    def __init__(self) -> None:
        self.once: set[int] = set()
        self.twice: set[int] = set()

    def proven(self, values: list[int], twice: np.ndarray) -> list[bool]:
        """True for values that need no counting elsewhere: others have been told of two places already."""
        if len(self.once) > REMEMBERED:
            self.once.clear()
            self.twice.clear()
        out = []
        for value, here in zip(values, twice.tolist()):
            known = value in self.twice
            if not known and (here or value in self.once):
                self.twice.add(value)
            self.once.add(value)
            out.append(known)
        return out


def _rows(key: list, value: list, times: list, proven: list) -> pa.RecordBatch:
    whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    columns = [whole(key, np.int64), whole(value, np.uint64).view(np.int64), whole(times, np.int64), whole(proven, bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "value", "times", "proven"])


ROWS = "key bigint, value bigint, times bigint, proven boolean"


def _distinct_rows(key: int, values: np.ndarray, among: np.ndarray, seen: Seen) -> tuple:
    """A row per distinct value, with how often it stands in ``among``."""
    values, among = np.unique(values), np.sort(among)
    times = np.searchsorted(among, values, "right") - np.searchsorted(among, values, "left")
    return np.full(len(values), key), values, times, np.array(seen.proven(values.tolist(), times > 1), bool)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _phrases(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), Seen()
        for batch in batches:
            parts: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _words(text.as_py())
                if len(words) >= window:
                    phrases, smallest = smallest_phrases(hashes.of(words), window)
                    parts.append(_distinct_rows(key, smallest, phrases, seen))
            yield _rows(*map(list, zip(*parts))) if parts else _rows([], [], [], [])

    return work


def _recurring(rows: DataFrame) -> DataFrame:
    """``key, values``: for each text those of its values that are found twice over all texts."""
    # rows proven in their task need no company and are dealt out by text
    group = ["value", F.when(F.col("proven"), F.col("key"))]
    counted = rows.select("key", "value", "proven", F.sum("times").over(Window.partitionBy(*group)).alias("all"))
    return counted.where("all > 1 or proven").groupBy("key").agg(F.collect_set("value").alias("values"))


#: Words of a shard: texts are gathered until they have so many, or one text has more.
SHARD_WORDS = 250_000
#: Window starts of a passage; a text asks for whole passages of its partners.
PASSAGE_STARTS = 96
#: Bytes of passages that are sent on together.
SENT_BYTES = 1 << 20
#: Letters that stand for a word in an automaton: three digits to the base 64 keep its nodes narrow; the
#: first is from an alphabet of its own, so a phrase is found at the start of a word only.
DIGITS = 3
FIRST, OTHER, ABSENT = 0x2000, 0x100, "\0" * DIGITS


def _letters(number: int) -> str:
    return chr(FIRST + (number >> 12)) + chr(OTHER + (number >> 6 & 63)) + chr(OTHER + (number & 63))


class Partners:
    """The second place that a task has met each window at, for all texts that have it later."""

    def __init__(self) -> None:
        self.once: set[int] = set()
        self.second: dict[int, tuple[int, int]] = {}

    def of(self, key: int, values: list[int], passages: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
        """Numbers of the values whose partner others must find, and the different partners of the rest."""
        if len(self.once) > REMEMBERED // 2:
            self.once.clear()
            self.second.clear()
        new, told = [], set()
        for i, value in enumerate(values):
            place = self.second.get(value)
            if place is not None:
                told.add(place)
                continue
            new.append(i)
            if value in self.once:
                self.second[value] = (key, passages[i])
            else:
                self.once.add(value)
        return new, sorted(told)


PLACES = "key bigint, value bigint, passage int, again int, partner bigint, partner_passage int"


def _places(window: int):
    """The windows around recurring phrases: hash, passage, and the last passage with it, too, if the text repeats it, else -1.

    Of windows with a partner known to the task only the different partners are told, under the hash zero; elsewhere their passage is -1.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    names = [field.split()[0] for field in PLACES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, partners = WordHashes(), Partners()
        for batch in batches:
            parts: list[tuple] = []
            texts = batch.column(1).field(_text_place(batch.schema.field(1).type))
            for key, text, recurring in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
                words = _words(text.as_py())
                if len(words) < window:
                    continue
                hashed = hashes.of(words)
                values = recurring.values.to_numpy(zero_copy_only=False).view(np.uint64)
                starts = np.flatnonzero(np.isin(smallest_phrases(hashed, window)[1], values))
                found = _joined(hashed ^ np.uint64(0x9E3779B97F4A7C15), window)[starts]
                distinct, first = np.unique(found, return_index=True)
                again = np.full(len(distinct), -1)
                if len(distinct) < len(found):
                    last = len(found) - 1 - np.unique(found[::-1], return_index=True)[1]
                    again = np.where(last > first, starts[last] // PASSAGE_STARTS, -1)
                distinct, first = distinct.view(np.int64), starts[first] // PASSAGE_STARTS
                new, told = partners.of(key, distinct.tolist(), first.tolist())
                if len(new) < len(distinct):
                    distinct, first, again = distinct[new], first[new], again[new]
                owner = np.full(len(distinct), key)
                parts.append((owner, distinct, first, again, owner, np.full(len(distinct), -1)))
                if told:
                    none = np.zeros(len(told), np.int64)
                    parts.append((none + key, none, none, none - 1, *np.array(told, np.int64).T))
            whole = [pa.array(np.concatenate(c), k, safe=False) for c, k in zip(zip(*parts), kinds)] if parts else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(whole, names)

    return work


def _asked(places: DataFrame) -> DataFrame:
    """``key, wanted``: for each text that is a partner, the passages of it that are wanted, and by which texts."""
    # rows that know their partner need no company and are dealt out by text
    told = F.col("partner_passage") >= 0
    own = F.struct("key", "passage")
    same = Window.partitionBy("value", F.when(told, F.col("key")))
    found = places.select("*", F.min(own).over(same).alias("low"), F.max(own).over(same).alias("high"))
    given = F.struct(F.col("partner").alias("key"), F.col("partner_passage").alias("passage"))
    other = F.when(told, given).when(F.col("low") != own, F.col("low")).when(F.col("high") != own, F.col("high"))
    # a window that only its own text repeats has partners there: its first place and its last
    inside = F.array(own, F.struct("key", F.col("again").alias("passage")))
    asks = found.withColumn("other", other).where("other IS NOT NULL OR again >= 0")
    asks = asks.select(F.col("key").alias("asker"), F.explode(F.when(F.col("other").isNull(), inside).otherwise(F.array("other"))).alias("at"))
    return asks.groupBy(F.col("at.key").alias("key")).agg(F.collect_set(F.struct("at.passage", "asker")).alias("wanted"))


def _passages(window: int):
    """One row per passage and text that wants it: ``key`` of that text, and the owner, first word and words."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "owner", "first", "words"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            texts = batch.column(1).field(_text_place(batch.schema.field(1).type))
            for owner, text, wanted in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
                words, cut = _words(text.as_py()), {}
                number, asker = (wanted.values.field(i).to_pylist() for i in range(2))
                for passage, key in zip(number, asker):
                    first = passage * PASSAGE_STARTS
                    if passage not in cut:
                        cut[passage] = b" ".join(words[first : first + PASSAGE_STARTS + window - 1]).decode()
                    out.append((key, owner, first, cut[passage]))
                    size += len(cut[passage])
                    if size >= SENT_BYTES:
                        yield rows(out)
                        out, size = [], 0
            yield rows(out)

    return work


class Shard:
    """Automaton of the anchors of passages; finds and confirms what texts share with them."""

    def __init__(self, window: int) -> None:
        self.window, self.size = window, phrase_words(window)
        self.numbers: dict[bytes, int] = {}
        self.origins: dict[str, list[tuple[int, int]]] = {}

    def add(self, owner: int, first: int, words: str) -> None:
        """A passage with its place; two places are enough to know that one of them is not a text's own."""
        places = self.origins.setdefault(words, [])
        if len(places) < 2 and (owner, first) not in places:
            places.append((owner, first))

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.letters: list[str] = []
        self.passages: list[tuple[np.ndarray, list[tuple[int, int]]]] = []
        self.anchors: list[list[tuple[int, int]]] = []
        known: dict[str, int] = {}
        for text, places in self.origins.items():
            numbers = [self.numbers.setdefault(w, len(self.numbers)) for w in text.encode().split()]
            self.letters += map(_letters, range(len(self.letters), len(self.numbers)))
            # every window holds an anchor that starts at a multiple of this
            for at in range(0, len(numbers) - self.size + 1, self.window - self.size + 1):
                anchor = "".join([self.letters[n] for n in numbers[at : at + self.size]])
                if anchor not in known:
                    known[anchor] = len(self.anchors)
                    self.anchors.append([])
                    self.automaton.add_word(anchor, known[anchor])
                self.anchors[known[anchor]].append((len(self.passages), at))
            self.passages.append((np.array(numbers, np.int64), places))
        self.letters.append(ABSENT)
        if len(self.automaton):
            self.automaton.make_automaton()

    def covered(self, key: int, words: list[bytes]) -> np.ndarray:
        """Words of a text in stretches of a window or more that a passage has, too, at another place than the text's own."""
        gone = np.zeros(len(words), bool)
        if not len(self.automaton):
            return gone
        numbers = [self.numbers.get(w, -1) for w in words]
        doc, reach = np.array(numbers, np.int64), self.window - self.size
        compared: set[tuple[int, int]] = set()
        for end, anchor in self.automaton.iter("".join([self.letters[n] for n in numbers])):
            at = end // DIGITS - self.size + 1
            # what lies further off is in reach of another anchor
            near = gone[max(0, at - reach) : at + self.window]
            if near.all():
                continue
            for passage, place in self.anchors[anchor]:
                start = at - place
                if (passage, start) in compared:
                    continue
                compared.add((passage, start))
                other, places = self.passages[passage]
                # a second place with the same words is never the text's own
                if len(places) > 1 or places[0] != (key, start):
                    self._mark(gone, doc, other, start)
        return gone

    def _mark(self, gone: np.ndarray, doc: np.ndarray, other: np.ndarray, start: int) -> None:
        """Mark the stretches of a window or more in which the text, from word ``start`` on, is the passage."""
        low, high = max(0, start), min(len(doc), start + len(other))
        if high - low < self.window:
            return
        differs = np.flatnonzero(doc[low:high] != other[low - start : high - start])
        if not len(differs):
            gone[low:high] = True
            return
        begin = low
        for stop in [*(differs + low).tolist(), high]:
            if stop - begin >= self.window:
                gone[begin:stop] = True
            begin = stop + 1


def _text_place(kind: pa.StructType) -> int:
    return kind.get_field_index("text")


def _removal(window: int):
    """Per text: its words, those that the shard's automaton found to recur, and what is left."""

    def cut(shard: list[tuple], passages: Shard) -> Iterator[tuple]:
        passages.compile()
        for key, words, asked, copied in shard:
            kept = words
            if copied:
                kept = []
            elif asked:
                gone = passages.covered(key, words)
                kept = [w for w, out in zip(words, gone.tolist()) if not out] if gone.any() else words
            joined = b" ".join(kept)
            yield len(words), len(words) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            shard: list[tuple] = []
            passages, n = Shard(window), 0
            texts = batch.column(1).field(_text_place(batch.schema.field(1).type))
            for key, text, found in zip(batch.column(0).to_pylist(), texts, batch.column(2)):
                words, copied = _words(text.as_py()), False
                asked = found.is_valid and len(words) >= window
                if asked:
                    for owner, first, stretch in zip(*(found.values.field(i).to_pylist() for i in range(3))):
                        if owner is None:
                            copied = True
                        else:
                            passages.add(owner, first, stretch)
                shard.append((key, words, asked, copied))
                n += len(words)
                if n >= SHARD_WORDS:
                    out += cut(shard, passages)
                    shard, passages, n = [], Shard(window), 0
            out += cut(shard, passages)
            columns = zip(*out) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["row", "n_words", "n_removed", "kept_text", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(1), *arrays], names)

    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, n_words, n_removed, kept_text, kept_sha256`` for every row of ``docs(doc_id, text, ...)``.

    ``row`` holds all columns of the input. Words are runs of bytes other than space and tab to carriage
    return, unchanged; a null or empty text has none. A word goes if a window of ``window`` words that covers it
    stands anywhere else too, in another row or the same; windows are judged on the input. ``kept_text`` is the words
    left, joined by one space. A text shorter than a window keeps everything. A repeated row is another place:
    both lose what they share. doc_id may be null, as rows are told apart by doc_id and text together.
    Nothing goes but what was found word for word elsewhere. Partners are sought by 64-bit hashes of windows: where a third,
    different window has the hash of two equal ones, these may not be led to one another and stay.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    rows = docs.select(key, F.struct("*").alias("row"))
    # the same exchange of whole rows serves all joins
    phrases = _recurring(docs.select(key, "text").mapInArrow(_phrases(window), ROWS))
    # sorted, so that a repeated task meets its texts in the same order and names the same partners
    candidates = rows.join(phrases, "key").select("key", "row", "values").sortWithinPartitions("key")
    asked = _asked(candidates.mapInArrow(_places(window), PLACES))
    schema = "key bigint, owner bigint, first int, words string"
    sent = rows.join(asked, "key").select("key", "row", "wanted").mapInArrow(_passages(window), schema)
    # rows that are repeated as a whole have each other for partners
    twice = docs.select(key, F.xxhash64(F.lit("twice"), "text", "doc_id").alias("mark")).groupBy("key", "mark").count().where("count > 1")
    nobody = [F.lit(None).cast(kind).alias(name) for kind, name in (("bigint", "owner"), ("int", "first"), ("string", "words"))]
    sent = sent.unionByName(twice.select("key", *nobody))
    passages = sent.groupBy("key").agg(F.collect_list(F.struct("owner", "first", "words")).alias("passages"))
    kind = rows.schema["row"].dataType.simpleString()
    return (
        rows.join(passages, "key", "left")
        .select("key", "row", "passages")
        .mapInArrow(_removal(window), f"row {kind}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with recurring passages cut out of ``text``, in the same columns.

    A text that loses nothing stays as it was, white space included; one that loses words is the words left, joined by
    one space, and its ``n_chars`` (if there is such a column) their length. A text that loses all is empty.
    """
    cut = remove_repeats(docs, window)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")).alias("text")
    chars = F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": chars}
    return cut.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
