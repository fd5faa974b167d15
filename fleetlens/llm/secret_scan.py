"""Secrets in texts, found by patterns and by two character Markov models, in column functions alone.

Three patterns give the base findings. Other long strings of key characters are compared under a model of random
strings and one of ordinary words: the log-likelihood ratio of their character pairs, per character, decides. Both models
are trained from a sample that labels itself: values that the patterns find are random strings, words of the
same documents are ordinary. Only the table of pair scores (128 x 128 numbers) passes the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, and their patterns. ``{n,}`` is used where it finds the same as a
#: filter on the length of greedy matches does, because a run of the class has one end.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_VALUE = 6

#: Strings the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Natural-log odds per character from which a string counts as random.
THRESHOLD = 0.5
#: Documents (those with the smallest hash of their row) that the models are trained on.
SAMPLE_DOCS = 4000
#: Weight, in pairs, of how often a character stands anywhere against how often it follows the one before it.
PULL = 4.0
CODES = 128
#: Characters of candidates; each counts once more than it was seen.
ALPHABET = 66
PLACEHOLDER = "[SECRET]"


#: Values that are folded at a time in running folds, as a power of two, and characters of a block of text.
FOLD_BITS = 8
TEXT_BLOCK = 4096


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; a column inside a lambda would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of numbers the fold of all before it, from 0; with n elements in about 128 n steps."""
    size, mask = 1 << FOLD_BITS, (1 << FOLD_BITS) - 1
    zero = F.lit(0)
    fold = lambda part: F.aggregate(part, zero, merge)

    def place(found: Column) -> Column:
        own = lambda i: F.slice(found["values"], i.bitwiseAND(F.lit(~mask)) + 1, i.bitwiseAND(F.lit(mask)))
        return F.transform(found["values"], lambda _, i: merge(F.get(found["starts"], F.shiftright(i, FOLD_BITS)), fold(own(i))))

    def blocks(of: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.shiftright(F.size(of), FOLD_BITS))
        return F.transform(numbers, lambda b: fold(F.slice(of, b * size + 1, F.lit(size))))

    def starts(found: Column) -> Column:
        before = F.transform(found["blocks"], lambda _, b: fold(F.slice(found["blocks"], F.lit(1), b)))
        return _bound(F.struct(found["values"].alias("values"), before.alias("starts")), place)

    return _bound(values, lambda v: _bound(F.struct(v.alias("values"), blocks(v).alias("blocks")), starts))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """``array<struct<start, kind, end, whole, value>>`` of the leftmost matches that do not overlap, by code points."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else whole
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,whole:string,value:string>>")

    def place(found: Column) -> Column:
        def one(pair: Column, i: Column) -> Column:
            start = F.get(found["before"], i) + F.length(pair["gap"])
            end = start + F.length(pair["whole"])
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["whole"].alias("whole"), pair["value"].alias("value"))

        return F.transform(found["pairs"], one)

    def walk(own: Column) -> Column:
        lengths = F.transform(own, lambda p: F.length(p["gap"]) + F.length(p["whole"]))
        before = _running(lengths, lambda a, n: a + n)
        return _bound(F.struct(own.alias("pairs"), before.alias("before")), place)

    # the gap after the last match has no match beside it
    walked = _bound(F.filter(pairs, lambda p: p["whole"].isNotNull()), walk)
    return F.when(F.rlike(text, F.lit(pattern)), walked).otherwise(empty)


def base_findings(text: Column) -> Column:
    """Base findings of a text that is not null, sorted by start and kind."""
    assigned = F.filter(_found(text, ASSIGN, 0), lambda m: F.length(m["value"]) >= ASSIGN_VALUE)
    return F.array_sort(F.concat(assigned, _found(text, ACCESS, 1), _found(text, HEX, 2)))


def _pairs(word: Column) -> Column:
    """Number of each pair of neighbours in an ASCII string of key characters."""
    codes = F.filter(F.transform(F.split(word, ""), lambda c: F.ascii(c)), lambda c: c > 0)
    pairs = lambda all_: F.transform(F.sequence(F.lit(0), F.size(all_) - 2), lambda i: F.get(all_, i) * CODES + F.get(all_, i + 1))
    return _bound(codes, pairs)


def _free(base: Column, candidates: Column) -> Column:
    """The candidates that no base finding overlaps: one that starts before a candidate's end must have ended at its start."""

    def outside(known: Column) -> Column:
        def begun(m: Column) -> Column:
            """How many findings start before the end of a candidate, by halving."""

            def halve(state: Column, _: Column) -> Column:
                middle = F.shiftright(state["lo"] + state["hi"], 1)
                before = (state["lo"] < state["hi"]) & (F.get(known["starts"], middle) < m["end"])
                lo = F.when(before, middle + 1).otherwise(state["lo"])
                return F.struct(lo.alias("lo"), F.when(before | (state["lo"] >= state["hi"]), state["hi"]).otherwise(middle).alias("hi"))

            steps = F.sequence(F.lit(0), F.length(F.bin(F.size(known["starts"]).cast("bigint"))))
            return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(known["starts"]).alias("hi")), halve)["lo"]

        return F.filter(candidates, lambda m: F.get(known["tops"], begun(m)) <= m["start"])

    # a last value of 0 gives the fold of all the others a place
    ends = F.concat(F.transform(base, lambda b: b["end"]), F.array(F.lit(0)))
    tops = _running(ends, lambda a, n: F.greatest(a, n))
    return _bound(F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), tops.alias("tops")), outside)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log odds of every pair of characters, random against ordinary, learnt from a bounded sample.

    The sample is the ``sample_docs`` documents whose hash is smallest, whole texts each. Without any document all odds are 0.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("mark"))
    cut = texts.select("mark").orderBy("mark").limit(sample_docs).agg(F.max("mark")).first()[0]
    if cut is None:
        return [0.0] * (CODES * CODES)
    sample = texts.where(F.col("mark") <= cut).select("text", base_findings(F.col("text")).alias("found"))
    secrets = sample.select(F.explode("found.value").alias("word"), F.lit(1).alias("label"))
    words = sample.select(F.explode(F.split("text", r"[^A-Za-z0-9+/_=-]+")).alias("word"), F.lit(0).alias("label"))
    plain = words.where(F.length("word").between(3, 19) & ~F.rlike("word", F.lit("[0-9]"))).groupBy("word", "label").agg(F.count("*").alias("n"))
    both = plain.unionByName(secrets.where(F.length("word") > 1).groupBy("word", "label").agg(F.count("*").alias("n")))
    counts = both.select("label", "n", F.explode(_pairs(F.col("word"))).alias("pair")).groupBy("label", "pair").agg(F.sum("n").alias("n"))
    return _odds({(r["label"], r["pair"]): r["n"] for r in counts.collect()})


def _odds(counts: dict[tuple[int, int], int]) -> list[float]:
    """Log odds per pair: a character's chance after another, drawn towards its chance anywhere."""

    def model(label: int):
        before, alone = [0] * CODES, [0] * CODES
        for (own, pair), n in counts.items():
            if own == label:
                before[pair // CODES] += n
                alone[pair % CODES] += n
        whole = sum(alone) + ALPHABET
        return lambda a, b: (counts.get((label, a * CODES + b), 0) + PULL * (alone[b] + 1) / whole) / (before[a] + PULL)

    random, ordinary = model(1), model(0)
    return [round(math.log(random(a, b) / ordinary(a, b)), 4) for a in range(CODES) for b in range(CODES)]


def find_secrets(docs: DataFrame, odds: list[float] | None = None) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` in a struct ``row``, with ``findings``.

    ``findings`` is an array of ``start, kind, end, whole, value`` sorted by start, then kind (0 to 3 as in KINDS); offsets are code points, the
    end exclusive; ``value`` is what an assignment assigns, else the whole. A random string is reported where no base finding
    overlaps it. Null and empty texts have none. Rows are judged one by one, so repeated rows have equal findings. Long texts are
    searched whole; the time for one grows little more than its length and its number of findings.
    """
    table = train(docs) if odds is None else odds
    scores = F.from_json(F.lit(json.dumps(table)), "array<double>")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumn("base", base_findings(text))
    odd = lambda m: F.aggregate(_pairs(m["whole"]), F.lit(0.0), lambda sum_, p: sum_ + F.get(scores, p))
    candidates = _found(text, CANDIDATE, 3)
    free = F.when(F.size("base") > 0, _free(F.col("base"), candidates)).otherwise(candidates)
    random = F.filter(free, lambda m: odd(m) > THRESHOLD * (F.length(m["whole"]) - 1))
    return rows.select("row", F.array_sort(F.concat("base", random)).alias("findings"))


def spans(findings: Column) -> Column:
    """``kind:start:end`` of findings, joined by commas."""
    kind = lambda m: F.element_at(F.array(*map(F.lit, KINDS)), m["kind"] + 1)
    return F.array_join(F.transform(findings, lambda m: F.concat_ws(":", kind(m), m["start"], m["end"])), ",")


def without_secrets(docs: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced; findings that overlap are replaced as one.

    The columns stay; ``n_chars``, if there, follows a changed text. Texts without findings, null ones too, are left alone.
    """
    found = find_secrets(docs)
    text = F.col("row.text")
    size = F.length(text)

    def between(blocks: Column, start: Column, end: Column) -> Column:
        """Characters from ``start`` to before ``end``, taken from the blocks that hold them."""
        cut = lambda b: F.substr(F.get(blocks, b), F.greatest(start - b * TEXT_BLOCK, F.lit(0)) + 1, F.least(end - b * TEXT_BLOCK, F.lit(TEXT_BLOCK)) - F.greatest(start - b * TEXT_BLOCK, F.lit(0)))
        numbers = F.sequence(F.floor(start / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int"))
        return F.when(end > start, F.array_join(F.transform(numbers, cut), "")).otherwise(F.lit(""))

    def redacted(state: Column) -> Column:
        def piece(m: Column, i: Column) -> Column:
            done = F.get(state["tops"], i)
            return F.when(m["start"] >= done, F.concat(between(state["blocks"], done, m["start"]), F.lit(placeholder))).otherwise(F.lit(""))

        # the fold of all ends stands at the place after the last finding
        rest = between(state["blocks"], F.element_at(state["tops"], -1), size)
        return F.concat(F.array_join(F.transform(state["all"], piece), ""), rest)

    ends = F.concat(F.transform("findings", lambda m: m["end"]), F.array(F.lit(0)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(size / TEXT_BLOCK).cast("int")), lambda b: F.substr(text, b * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)))
    tops = _running(ends, lambda a, n: F.greatest(a, n))
    whole = F.struct(F.col("findings").alias("all"), blocks.alias("blocks"), tops.alias("tops"))
    clean = F.when(F.size("findings") > 0, _bound(whole, redacted)).otherwise(text)
    done = found.select("row", "findings", clean.alias("clean"))
    chars = F.when(F.size("findings") > 0, F.length("clean").cast("bigint"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(chars, F.col("row.n_chars"))
    return done.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
