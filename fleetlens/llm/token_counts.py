"""Token totals by source, language and tokenizer version, kept up to date from signed changes.

Of all changes to a document and tokenizer the largest by seq holds, whichever batch brings it, so a late batch undoes nothing newer and
totals do not hang on how changes were dealt into batches. A batch is compared with what its part of the ledger holds; the
changes that win are written there with what they replace, and signed sums per source, language and tokenizer
(the old counts negative) beside them. Sums come last, and the success mark that Spark writes at the end of a job is the
commit: a batch with the mark is never applied again; one without it left nothing that readers see and is written anew.
Totals are the sum of all committed sums.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "tokenizer")
#: What a change sets, in the order in which changes to one document and tokenizer are compared.
HELD = "struct<seq:bigint,op:string,tokens:bigint,source:string,lang:string>"
DRAFT = f"doc_id bigint, tokenizer string, new {HELD}, bucket int"
LEDGER = f"doc_id bigint, tokenizer string, new {HELD}, old {HELD}, bucket int"
#: Parts of the ledger by document. A batch reads those that its documents lie in; more parts suit larger ledgers.
BUCKETS = 32
SUMS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
#: Columns of a batch. op: insert, revise or delete; of several changes to one document and tokenizer the one with the highest seq holds, in any batch.
CHANGES = "op string, seq bigint, doc_id bigint, source string, lang string, tokenizer string, tokens bigint"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words between white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def utf8_bytes(text: Column) -> Column:
    """Tokens of a byte-level vocabulary without merges."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def counted(docs: DataFrame, tokenizers: dict[str, Column]) -> DataFrame:
    """``doc_id, source, lang, tokenizer, tokens``: a row per document and named count."""
    pairs = F.array(*(F.struct(F.lit(name).alias("tokenizer"), count.alias("tokens")) for name, count in tokenizers.items()))
    return docs.select("doc_id", "source", "lang", F.inline(pairs))


def _counter(path: str) -> Callable[[str], int]:
    """Number of tokens of a text under a tokenizer file, or under ranks, special tokens not added."""
    if not path.endswith(".tiktoken"):
        from .packing import encoder

        own = encoder(path)
        return lambda text: len(own.ids(text)) - 1
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(ranked.encode_ordinary(text))


_counters: dict[str, Callable[[str], int]] = {}


def counted_by_file(docs: DataFrame, name: str, tokenizer_path: str) -> DataFrame:
    """The same under a tokenizer file (``.json``, or ``.tiktoken`` for ranks); a null text counts 0. A worker loads a file once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _counters:
            _counters[tokenizer_path] = _counter(tokenizer_path)
        count = _counters[tokenizer_path]
        for batch in batches:
            tokens = [count(t.as_py()) if t.is_valid else 0 for t in batch.column(3)]
            columns = [*batch.columns[:3], pa.array([name] * len(tokens), pa.string()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "lang", "tokenizer", "tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "source", "lang", "text")
    return rows.mapInArrow(work, "doc_id bigint, source string, lang string, tokenizer string, tokens bigint")


class TokenRollup:
    """Totals kept in a folder that all executors share. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        """``buckets`` belongs to the folder: give the same number whenever it is opened."""
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _place(self, kind: str, batch: str) -> str:
        return f"{self.folder}/{kind}/batch={quote(batch, safe='')}"

    def _system(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self._system().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._place('sums', batch)}/_SUCCESS"))

    def _committed_names(self) -> list[str]:
        """Names of the batches that hold, one per batch, not per document."""
        system, Path = self._system(), self.spark._jvm.org.apache.hadoop.fs.Path
        found = system.globStatus(Path(f"{self.folder}/sums/*/_SUCCESS")) or []
        return sorted(status.getPath().getParent().getName() for status in found)

    def _read(self, kind: str, schema: str) -> DataFrame:
        places = [f"{self.folder}/{kind}/{name}" for name in self._committed_names()]
        if not places:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*places)
        return rows.drop("batch")

    def _held(self) -> DataFrame:
        """The largest change so far of each document and tokenizer, deletions included."""
        return self._read("ledger", LEDGER).groupBy("bucket", "doc_id", "tokenizer").agg(F.max("new").alias("old"))

    def current(self) -> DataFrame:
        """What each document counts now: ``doc_id, source, lang, tokenizer, tokens``."""
        held = self._held().where("old.op <> 'delete'")
        return held.select("doc_id", "old.source", "old.lang", "tokenizer", "old.tokens")

    def _draft(self, batch: str, changes: DataFrame) -> DataFrame:
        """The largest change of a batch to each document and tokenizer, written by part of the ledger."""
        sound = "doc_id IS NOT NULL AND tokenizer IS NOT NULL AND (op = 'delete' OR (op IN ('insert', 'revise') AND tokens IS NOT NULL))"
        change = F.struct("seq", "op", "tokens", "source", "lang").cast(HELD)
        largest = changes.where(sound).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "tokenizer").agg(F.max(change).alias("new"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        place = self._place("drafts", batch)
        largest.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        return self.spark.read.schema(DRAFT).parquet(place)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch (columns CHANGES) once. False if it is committed already; nothing is read or written then.

        Insert and revise both set a document's count under a tokenizer, so an insert that comes twice is no second document; a
        delete holds against changes with smaller seq that come later. Of equal seq (null is the smallest) the largest by op, tokens,
        source and language holds. Changes without doc_id, tokenizer, or (but for a delete) tokens are left out; null
        sources and languages are groups of their own.
        """
        if self.committed(batch):
            return False
        draft = self._draft(batch, changes)
        # at most as many numbers as the ledger has parts
        buckets = [r.bucket for r in draft.select("bucket").distinct().collect()]
        old = self._held().where(F.col("bucket").isin(buckets))
        won = draft.join(old, ["bucket", "doc_id", "tokenizer"], "left").where("old IS NULL OR new > old")
        ledger = self._place("ledger", batch)
        written = won.select("doc_id", "tokenizer", "new", "old", "bucket").repartition("bucket").write.mode("overwrite")
        written.partitionBy("bucket").parquet(ledger)

        def entry(part: str, sign: int):
            counts = F.struct(
                F.col(f"{part}.source"), F.col(f"{part}.lang"), F.lit(sign).cast("bigint").alias("documents"), (sign * F.col(f"{part}.tokens")).alias("tokens")
            )
            return F.when(F.col(f"{part}.op") != "delete", counts)

        rows = self.spark.read.schema(LEDGER).parquet(ledger)
        signed = rows.select("tokenizer", F.inline(F.array_compact(F.array(entry("old", -1), entry("new", 1)))))
        sums = signed.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        sums.where("documents <> 0 OR tokens <> 0").write.mode("overwrite").parquet(self._place("sums", batch))
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, documents, tokens`` of all committed batches; groups without documents are left out."""
        sums = self._read("sums", SUMS).groupBy(*GROUP)
        return sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).where("documents <> 0 OR tokens <> 0")


def inserts(counts: DataFrame, seq: int = 0, op: str = "insert") -> DataFrame:
    """Counts as changes of one kind."""
    return counts.select(F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"), "doc_id", *GROUP, "tokens")
