"""One query per operator over the driver's tables, with production parameters and whole inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import bpe, language_id
from .licenses import joined_labels, scan_licenses
from .packing import Limits, pack
from .passages import remove_repeats
from .periodic_runs import find_runs, longest, with_planted_tails
from .quality_rules import judge
from .resampling import resample
from .secret_scan import KINDS, find_secrets, spans
from .simhash import near_duplicates
from .token_counts import TokenRollup, counted, counted_by_file, inserts, utf8_bytes, words
from .topk import integer_vectors, top_k
from .warc import archive, read_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sql_crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes; ``crc_table(t)`` must be in scope."""
    byte = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


CRC_TABLE = """crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
               lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    )"""


@query()
def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), n_words=3, max_bits=2)


@query(
    r"""
    WITH words AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
    ), starts AS (
        SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words
    ), windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(w[i:i + 34], ' '))) AS n FROM starts
    ), covered AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM windows WHERE n > 1
    ), gone AS (
        SELECT doc_id, list(place) AS places FROM covered GROUP BY doc_id
    ), kept AS (
        SELECT doc_id, len(w) AS n_words, len(coalesce(places, [])) AS n_removed,
               list_filter(w, lambda x, i: NOT list_contains(coalesce(places, []), i)) AS k
        FROM words LEFT JOIN gone USING (doc_id)
    )
    SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
    """
)
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), window=35)
    return cut.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("findings", lambda m: m["kind"] < 3)
    count = lambda k: F.size(F.filter("findings", lambda m: m["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select(
        "row.doc_id", *(count(k) for k in range(3)), F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans")
    )


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op3_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), Limits(tokens=1024), ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"))


@query(
    """
    WITH vectors AS (
        SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
        SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM vectors q JOIN vectors c ON q.place <> c.place WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """
)
def op2_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors, k=20)


@query()
def op6_language_by_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.train(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"))).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query(
    """
    WITH payloads AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), firsts AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM payloads
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
    FROM firsts
    """
)
def op7_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_pages(archive(table(spark, sf_dir, "pages", "page_id", "url", "html")), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


LONE_BAR = r"(?<![^\x20\x09-\x0D])\|(?![^\x20\x09-\x0D])"


@query(
    r"""
    WITH docs AS (
        SELECT source, lang, coalesce(text, '') AS text, doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
    ), counts AS (
        SELECT source, lang, 'words-1' AS tokenizer,
               len(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: w <> '|')) AS tokens FROM docs WHERE first
        UNION ALL
        SELECT source, lang, 'bytes-1', octet_length(encode(text)) FROM docs WHERE first
    )
    SELECT source, lang, tokenizer, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM counts GROUP BY ALL
    """
)
def token_totals_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and bytes in place of a vocabulary's tokens, which SQL can count too. All documents come, table bars stop counting as words,
    exact copies go. The last two batches come twice."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    text = F.col("text")
    names = {"words-1": words(text), "bytes-1": utf8_bytes(text)}
    bars = F.regexp_count(text, F.lit(LONE_BAR))
    revised = inserts(counted(docs.where(bars > 0), {"words-1": words(text) - bars}), 1, "revise")
    return _totals_after(spark, [("load", inserts(counted(docs, names))), *2 * [("bars", revised), ("copies", _copies_gone(docs, list(names)))]])


@query()
def op5_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals under two versions of a public tokenizer. All documents come under the first, then under the second; under the first, table bars
    are taken out of texts; exact copies go under both. The last two batches come twice, and the first again at the end."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    first, second = "byte_bpe_50k", "byte_bpe_multi_50k"
    load = inserts(counted_by_file(docs, first, vocabulary(f"{first}.json")))
    added = inserts(counted_by_file(docs, second, vocabulary(f"{second}.tiktoken")))
    barred = docs.where(F.rlike("text", F.lit(LONE_BAR))).withColumn("text", F.regexp_replace("text", LONE_BAR, ""))
    revised = inserts(counted_by_file(barred, first, vocabulary(f"{first}.json")), 1, "revise")
    gone = _copies_gone(docs, [first, second])
    return _totals_after(spark, [("load", load), ("added", added), *2 * [("bars", revised), ("copies", gone)], ("load", load)])


def _copies_gone(docs: DataFrame, tokenizers: list[str]) -> DataFrame:
    """Deletions of all but the first of documents with equal texts."""
    marks = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("mark"))
    first = marks.groupBy("mark").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = marks.join(first, "mark").where("doc_id <> first_id")
    return inserts(counted(copies, {name: F.lit(0).cast("bigint") for name in tokenizers}), 2, "delete")


def _totals_after(spark: SparkSession, batches: list[tuple[str, DataFrame]]) -> DataFrame:
    rollup = TokenRollup(spark, f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}")
    for name, changes in batches:
        rollup.commit(name, changes)
    return rollup.totals()


@query(
    rf"""
    WITH {CRC_TABLE}, texts AS (
        SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
    ), words AS (
        SELECT side, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts
    ), counted AS (
        SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL
    ), buckets AS (
        SELECT word, {sql_crc32("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM counted), crc_table
    ), totals AS (
        SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
        FROM counted JOIN buckets USING (word) GROUP BY bucket
    ), gains AS (
        SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (SELECT sum(s) + 10000 FROM totals)::DOUBLE
                                       / ((s + 1)::DOUBLE * (SELECT sum(t) + 10000 FROM totals)::DOUBLE)))::BIGINT AS gain FROM totals
    ), sums AS (
        SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
        FROM counted JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
    ), weighed AS (
        SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
               CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
               ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
        FROM documents d LEFT JOIN sums USING (doc_id)
    ), scored AS (
        SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
    ), ranked AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank
    FROM scored LEFT JOIN ranked USING (doc_id)
    """
)
def op11_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return resample(docs, target, percent=10, min_words=20, runs=1, buckets=10_000, seed=2024).drop("n_words")


@query(
    rf"""
    WITH {CRC_TABLE}, words AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
               {sql_crc32("doc_id::VARCHAR")} AS h FROM documents, crc_table
    ), chosen AS (
        SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM words
    ), docs AS (
        SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x
                   ELSE w[a + (i - 1 - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END) END AS w FROM chosen
    ), places AS (
        SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM docs
    ), phrases AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 5], ' ')) AS phrase FROM places
    ), matches AS (
        SELECT x.doc_id, y.i - x.i AS q, x.i FROM phrases x JOIN phrases y ON x.doc_id = y.doc_id AND x.phrase = y.phrase AND y.i > x.i
    ), islands AS (
        SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matches
    ), stretches AS (
        SELECT doc_id, min(i) - 1 AS s, max(i) - min(i) + 6 + q AS n, q FROM islands GROUP BY doc_id, q, island
    ), runs AS (
        SELECT doc_id, s, n, min(q) AS q FROM stretches WHERE n >= 12 AND n >= 2 * q GROUP BY doc_id, s, n
    ), best AS (
        SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, q) = 1
    ), lines AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS line FROM runs GROUP BY doc_id
    ), gone AS (
        SELECT doc_id, list(DISTINCT place) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + n)) AS place FROM runs) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, n AS length, q AS period, 1000 * n // q AS exponent_milli,
           sha256(coalesce(line, '')) AS runs_sha256,
           sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), ' ')) AS collapsed_sha256
    FROM docs LEFT JOIN lines USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN gone USING (doc_id)
    """
)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_tails(table(spark, sf_dir, "documents", "doc_id", "text")), text=False)
    top = found.withColumn("top", longest(F.col("runs")))
    exponent = F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period"))
    count = F.size("runs").cast("bigint").alias("n_runs")
    return top.select("doc_id", count, "top.*", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query()
def op13_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["exact"])
    places = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined_labels(base).alias("base_labels"),
        joined_labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
