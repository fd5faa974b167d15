"""SimHash near-duplicates found with BK-trees over bounded shards of fingerprints.

The set of distinct fingerprints is cut into shards of some hundreds of codes, and each shard is searched by a tree: every code lies below
its parent on the edge of the integer distance of the two, and a search follows only edges whose distance is within r of its own. Shards
are made so that two codes at most r bits apart share one: they agree on at least one whole of r + 1 blocks of bits, so every code is filed
under some bits of each block, as many as the number of codes asks for. What a tree searches is much wider than what it links: codes of a
shard agree on a few bits only, and the tree alone tells which are near.

A shard that holds far more codes than others (fingerprints of like texts) is filed again, by a part of its remaining bits; as its
codes agree on one block, the remaining bits of two near codes agree on one of r + 1 parts. What is too large even then is
split, and every part of its codes goes to the trees of all its parts, which are broadcast when their number is small.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .components import connected_components

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
#: Trees of split shards that may be broadcast; one holds at most about ``shard_codes`` codes of 8 bytes.
BROADCAST_TREES = 64


def fingerprint(text: str | None, n_words: int) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 for a null or wordless one."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(n_words, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = [xxh64_intdigest(joined[i:j], SEED) for i, j in zip(first[at : at + CHUNK], last[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, n_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, code``: one row per input row, code the signed fingerprint of its whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [fingerprint(text.as_py(), n_words) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], ["doc_id", "code"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, code bigint")


class BKTree:
    """Codes by their distance to the parent. ``parents`` and ``edges`` are enough to send a tree."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.parents: list[int] = []
        self.edges: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        """File a code (unsigned); one that is there already is left out."""
        at, edge = -1, 0
        if self.codes:
            at = 0
            while True:
                edge = (self.codes[at] ^ code).bit_count()
                if edge == 0:
                    return
                child = self.children[at].get(edge)
                if child is None:
                    break
                at = child
            self.children[at][edge] = len(self.codes)
        self.codes.append(code)
        self.parents.append(at)
        self.edges.append(edge)
        self.children.append({})

    def within(self, code: int, radius: int) -> Iterator[int]:
        """Places of the codes at most ``radius`` bits away."""
        todo = [0] if self.codes else []
        while todo:
            at = todo.pop()
            distance = (self.codes[at] ^ code).bit_count()
            if distance <= radius:
                yield at
            below = self.children[at]
            if below:
                todo += [below[edge] for edge in range(max(distance - radius, 1), distance + radius + 1) if edge in below]

    @classmethod
    def rebuilt(cls, codes: list[int], parents: list[int], edges: list[int]) -> BKTree:
        tree = cls()
        tree.codes, tree.parents, tree.edges = codes, parents, edges
        tree.children = [{} for _ in codes]
        for place, (parent, edge) in enumerate(zip(parents, edges)):
            if parent >= 0:
                tree.children[parent][edge] = place
        return tree


MASK = (1 << BITS) - 1


def _signed(code: int) -> int:
    return code - (1 << BITS) if code >> (BITS - 1) else code


def _spanning(tree: BKTree, queries: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what the tree and the queries connect, one fewer than there are codes at most."""
    root: dict[int, int] = {}

    def find(code: int) -> int:
        top = code
        while root.get(top, top) != top:
            top = root[top]
        while root.get(code, code) != top:
            root[code], code = top, root[code]
        return top

    for query in queries:
        for place in tree.within(query, radius):
            a, b = find(query), find(tree.codes[place])
            if a != b:
                root[max(a, b)] = min(a, b)
                yield _signed(query), _signed(tree.codes[place])


def _links_inside(radius: int):
    """Links within whole shards: the tree is built and every code of the shard looked up in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for codes in batch.column(0):
                own, tree = [c & MASK for c in codes.as_py()], BKTree()
                for code in own:
                    tree.add(code)
                found += _spanning(tree, own, radius)
            yield _link_batch(found)

    return work


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "shard", "tree_codes", "parents", "edges"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        rows = []
        for key, shard, codes in zip(*(batch.column(i).to_pylist() for i in range(3))):
            tree = BKTree()
            for code in codes:
                tree.add(code & MASK)
            rows.append((key, shard, [_signed(c) for c in tree.codes], tree.parents, tree.edges))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _links_between(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                tree = BKTree.rebuilt([c & MASK for c in row["tree_codes"]], row["parents"], row["edges"])
                found += _spanning(tree, [c & MASK for c in row["codes"]], radius)
            yield _link_batch(found)

    return work


#: Codes that a tree holds on average.
TREE_CODES = 512


def _bits_of(places: range | list[int]) -> Column:
    """The bits of a code at some places."""
    mask = sum(1 << place for place in places)
    return F.col("code").bitwiseAND(F.lit(_signed(mask)))


def _parts(places: list[int], n: int) -> list[list[int]]:
    return [places[len(places) * i // n : len(places) * (i + 1) // n] for i in range(n)]


def _filed(codes: DataFrame, max_bits: int, shard_codes: int) -> DataFrame:
    """``code, key, n``: every code under the keys of its shards, those of one code alone left out, with the shard's number of codes."""
    blocks = _parts(list(range(BITS)), max_bits + 1)
    # the more codes, the more bits of a block part them
    wide = math.ceil(math.log2(max(1, codes.count() / min(TREE_CODES, shard_codes))))
    keys = [F.xxhash64(F.lit(i), _bits_of(block[:wide])) for i, block in enumerate(blocks)]
    first = _sized(codes.select("code", F.posexplode(F.array(*keys)).alias("block", "key")))
    small, large = first.where(F.col("n") <= shard_codes), first.where(F.col("n") > shard_codes)
    again = []
    for i, block in enumerate(blocks):
        rest = _parts([place for place in range(BITS) if place not in block], max_bits + 1)
        # near codes that meet here for good agree on the whole block, the bits that have not parted them yet too
        again.append(F.array(*(F.xxhash64("key", _bits_of(block), F.lit(j), _bits_of(part)) for j, part in enumerate(rest))))
    finer = _sized(large.select("code", "block", F.explode(F.element_at(F.array(*again), F.col("block") + 1)).alias("key")))
    return small.unionByName(finer).select("code", "key", "n")


def _sized(filed: DataFrame) -> DataFrame:
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return filed.join(sizes, "key")


def code_links(codes: DataFrame, max_bits: int = 2, shard_codes: int = 4096) -> DataFrame:
    """``a, b``: links that connect every two distinct ``code`` values at most ``max_bits`` bits apart.

    Within a shard only a spanning forest of the links is given; which codes are connected is exact.
    """
    filed = _filed(pin(codes), max_bits, shard_codes).withColumn("shards", F.ceil(F.col("n") / shard_codes))
    shard = F.pmod(F.xxhash64("code", F.lit(SEED)), F.col("shards"))
    shards = pin(filed.groupBy("key", "shards", shard.alias("shard")).agg(F.collect_list("code").alias("codes")))
    whole = shards.where("shards = 1").select("codes").mapInArrow(_links_inside(max_bits), "a bigint, b bigint")

    split = shards.where("shards > 1")
    schema = "key bigint, shard bigint, tree_codes array<bigint>, parents array<int>, edges array<int>"
    trees = split.select("key", "shard", "codes").mapInArrow(_build, schema)
    if split.count() <= BROADCAST_TREES:
        trees = F.broadcast(trees)
    # every part of the codes meets its own tree and those after it once
    sent = split.select("key", "codes", F.explode(F.sequence("shard", F.col("shards") - 1)).alias("shard"))
    across = sent.join(trees, ["key", "shard"]).select("codes", "tree_codes", "parents", "edges")
    return whole.unionByName(across.mapInArrow(_links_between(max_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, n_words: int = 3, max_bits: int = 2, shard_codes: int = 4096) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Words are runs of bytes other than space and tab to carriage return, with A-Z lower-cased; a text of fewer
    than ``n_words`` words is one shingle; a null, empty or wordless text has the fingerprint zero and is linked like any
    other. ``component_id`` is the smallest doc_id that links lead to. Equal fingerprints are one
    node, so a group of copies costs one code however large it is. A repeated row comes back as often as it was
    given. A row without doc_id has a fingerprint and, as others may lead to it, the component of its code;
    that is null if no row of the component has a doc_id. Other columns of ``docs`` are not read.
    """
    marks = pin(fingerprints(docs, n_words))
    codes = marks.groupBy("code").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(code_links(codes.select("code"), max_bits, shard_codes))
    placed = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_code = placed.join(named, "root").select("code", "component_id")
    digits = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return marks.join(by_code, "code").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, n_words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component, all columns as they were.

    A doc_id names one document: of rows that repeat it the one with the smallest hash of its text counts, before groups are formed, and the
    others go. Rows without doc_id stay, as no link can name them.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    marked = named.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"))
    ids = marked.groupBy("_id").agg(F.count("*").alias("n"), F.min("_mark").alias("first"))
    repeated = ids.where("n > 1")
    if not repeated.isEmpty():
        marked = marked.join(repeated.select("_id", "first"), "_id", "left").where("first IS NULL OR first = _mark").dropDuplicates(["_id"])
        named = pin(marked.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
    groups = near_duplicates(named, n_words, max_bits)
    keep = groups.where("doc_id = component_id").select("doc_id")
    return named.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
