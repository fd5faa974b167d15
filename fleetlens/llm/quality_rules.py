"""Quality rules learnt from labelled statistics as an ordered decision list.

Sequential covering: while rejected examples are left, a conjunction of thresholds is grown on two thirds of
the sample, pruned on the other third, and kept only if it is precise there; what it covers is set aside. The
list becomes one Spark ``CASE WHEN`` over the statistics, so applying it needs no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols (fixed values of the contract).
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_lines", "n_ended", "n_distinct")
#: Labelled rows that rules are learnt from: those with the smallest hash of their doc_id.
SAMPLE_ROWS = 20_000
#: A rule must be right on so many of the held-out examples that it covers, by its lower estimate.
PRECISION = 0.97
MIN_COVER = 5
MAX_RULES = 16
MAX_CONDITIONS = 4
CUTS = 32


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    # two steps, each numbered anew, keep the codes small whatever the vocabulary
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, place, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def _measure(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.split()]
    points = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((points & 0xC0) != 0x80).sum())
    by_byte = np.bincount(points, minlength=256)
    return (
        len(words),
        chars,
        int(by_byte[list(SYMBOLS.encode())].sum()),
        len(lines) - len(set(lines)),
        _repeated(words),
        int(by_byte[65:91].sum()),
        int(by_byte[48:58].sum()),
        len(lines),
        sum(line.rstrip()[-1:] in b".!?" for line in lines),
        len(set(words)),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``) with whole-text statistics, one long each.

    A null or empty text has all statistics zero. Words are runs of bytes other than space and tab to carriage
    return; ``word_chars`` are their code points; ``n_symbols`` counts characters of ``#*$%&|<>``; ``n_dup_lines`` lines with
    a word that equal an earlier line; ``n_repeat_words`` words in three-word windows found twice or more in the
    text; the others are ASCII capitals, ASCII digits, lines with a word, those that end a sentence, distinct words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            found = [_measure(t.as_py()) for t in rows.field(rows.type.get_field_index("text"))]
            columns = zip(*found) if found else ((),) * len(STATISTICS)
            yield pa.RecordBatch.from_arrays([rows, *(pa.array(c, pa.int64()) for c in columns)], ["row", *STATISTICS])

    rows = docs.select(F.struct("*").alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{s} bigint" for s in STATISTICS)
    return rows.mapInArrow(work, schema)


#: Derived ratios the rules may test, as SQL over the statistics; a zero divisor counts as one.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "ended_ratio": "n_ended / greatest(n_lines, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.feature]
        return values > self.threshold if self.above else values <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(table.values()))), bool)
    for condition in rule:
        held &= condition.holds(table)
    return held


def _gain(bad: float, good: float, was_bad: float, was_good: float) -> float:
    """Information gained on the rejected examples that stay covered."""
    return bad * (np.log2(bad / (bad + good)) - np.log2(was_bad / (was_bad + was_good)))


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: list[Condition] = []
    held = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (held & ~bad).any():
        n_bad, n_good = (held & bad).sum(), (held & ~bad).sum()
        best, most = None, 1e-9
        for feature, values in table.items():
            cuts = np.unique(np.quantile(values[held & bad], np.linspace(0, 1, CUTS)))
            cuts = np.unique(np.concatenate([cuts, np.nextafter(cuts, -np.inf)]))
            for cut in cuts.tolist():
                for above in (True, False):
                    condition = Condition(feature, above, float(cut))
                    mask = held & condition.holds(table)
                    b, g = (mask & bad).sum(), (mask & ~bad).sum()
                    if b and (gain := _gain(b, g, n_bad, n_good)) > most:
                        best, most = condition, gain
        if best is None:
            break
        rule.append(best)
        held &= best.holds(table)
    return tuple(rule)


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    """Share of rejected examples among those covered, with one miss added, and their number."""
    held = _covers(rule, table)
    n = int((held & bad).sum())
    return n / (int(held.sum()) + 1), n


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The rule without final conditions that do not help on held-out examples."""
    score = lambda r: (lambda h: ((h & bad).sum() - 4 * (h & ~bad).sum()) / max(len(bad), 1))(_covers(r, table))
    return max((rule[:n] for n in range(1, len(rule) + 1)), key=lambda r: (score(r), -len(r)))


def learn(table: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules for the rejected class. ``fold`` is 0, 1 or 2 per example; examples of fold 2 prune."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = lambda mask: ({k: v[mask] for k, v in table.items()}, bad[mask])
    while len(rules) < MAX_RULES and (left & bad & (fold < 2)).any():
        rule = _grow(*part(left & (fold < 2)))
        if not rule:
            break
        held_out = part(left & (fold == 2))
        rule = _prune(rule, *held_out)
        share, n = _worth(rule, *held_out)
        if n < MIN_COVER or share < precision * n / (n + 1):
            break
        rules.append(rule)
        left &= ~_covers(rule, table)
    return rules


def train(measured: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> list[Rule]:
    """Rules from the statistics of labelled documents: quality 0 is rejected, 1 is not; null labels are left out.

    Fitted on the driver from the ``sample_rows`` labelled doc_ids whose hash is smallest. A doc_id with both labels counts as good.
    Without labelled documents, or where no rule is precise enough, the list is empty.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    mark = F.xxhash64("doc_id")
    known = known.orderBy(mark, "doc_id").limit(sample_rows)
    plain = measured.select("row.doc_id", *(F.expr(sql).alias(name) for name, sql in FEATURES.items()))
    joined = plain.join(F.broadcast(known), "doc_id").select("quality", *FEATURES, F.pmod(mark, F.lit(3)).alias("fold"))
    # a doc_id may be repeated; the limit keeps the sample bounded even so
    rows = joined.limit(2 * sample_rows).toPandas()
    table = {name: rows[name].to_numpy(float) for name in FEATURES}
    return learn(table, rows["quality"].to_numpy() == 0, rows["fold"].to_numpy(), precision)


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {repeat_percent} * n_words")


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects; the first rule that holds decides."""
    kept = None
    for rule in rules:
        held = F.expr(" AND ".join(c.sql() for c in rule))
        kept = F.when(held, F.lit(False)) if kept is None else kept.when(held, F.lit(False))
    return F.lit(True) if kept is None else kept.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``row``, the statistics, ``base_failed`` and ``kept`` of every row of ``docs(doc_id, text, ...)``.

    Rules are learnt from ``labels(doc_id, quality)`` unless given. A null or empty text fails the base rule (no words). Rows are
    judged one by one: repeated rows get the same verdict, and one without doc_id is judged like any other.
    """
    measured = statistics(docs)
    if rules is None:
        rules = train(statistics(docs.select("doc_id", "text").join(_labelled(labels), "doc_id", "left_semi")), labels)
    failed = base_failed()
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))


def _labelled(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The sampled doc_ids, a bounded number: other documents need not be measured to learn."""
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id").distinct()
    return F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass base rules and learnt rules, unchanged."""
    judged = judge(docs, labels).where("kept")
    return judged.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
