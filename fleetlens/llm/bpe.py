"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are laid end to end as an array of code points, each mapped to a class. A small automaton
runs over the classes; its step is a function on states, and functions compose associatively, so the array is cut into rows, the
functions of all rows are composed side by side, their prefixes give each row its first state, and a second pass
writes every state. Where a token starts follows from the states of a character and its neighbours. The slices of
UTF-8 bytes between starts are merged by rank, with the ids of recent slices kept in a bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of characters. The letters that can follow an apostrophe in a contraction have their own.
BREAK, LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, ONE, RV, ELL, E = range(11)
#: States after a character: in a letter run, a number run, a run of others, at an apostrophe that begins a token,
#: at a blank, at other white space, at the end of a contraction, inside one after r or v, or after l; at a text's start.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_QUOTE, AT_BLANK, AT_SPACE, CONTRACTED, AFTER_RV, AFTER_ELL, START = range(10)
STATES = 10
#: Characters composed in one row, and characters handled at a time.
ROW = 128
CHARS = 1 << 18
#: Bytes that the slices a worker remembers may take, and about what one takes besides its own bytes and ids.
REMEMBERED_BYTES = 24 << 20
ENTRY_BYTES, ID_BYTES = 200, 36


def _table() -> np.ndarray:
    """Next state by class and state, flattened with 16 states to a class."""
    table = np.zeros((11, 16), np.uint8)
    table[BREAK] = START
    table[[LETTER, ONE, RV, ELL, E]] = IN_LETTERS
    table[NUMBER] = IN_NUMBERS
    table[OTHER] = IN_OTHERS
    table[QUOTE] = AT_QUOTE
    table[QUOTE, [IN_OTHERS, AT_QUOTE, AT_BLANK]] = IN_OTHERS
    table[BLANK], table[SPACE] = AT_BLANK, AT_SPACE
    table[ONE, AT_QUOTE] = CONTRACTED
    table[RV, AT_QUOTE], table[ELL, AT_QUOTE] = AFTER_RV, AFTER_ELL
    table[E, AFTER_RV] = table[ELL, AFTER_ELL] = CONTRACTED
    return table.ravel()


STEP = _table()
#: White space by the Unicode property; fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    """Class of every code point, and of one beyond them that parts texts."""
    by_category = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((by_category.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    classes[WHITE] = SPACE
    for letters, kind in (("stmd", ONE), ("rv", RV), ("l", ELL), ("e", E), ("'", QUOTE), (" ", BLANK)):
        classes[[ord(c) for c in letters]] = kind
    return np.append(classes, np.uint8(BREAK))


_known_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _known_classes:
        _known_classes.append(_classes())
    return _known_classes[0]


def scan(kinds: np.ndarray) -> np.ndarray:
    """State after every character, by composing the rows' transition functions."""
    n = len(kinds)
    rows = -(-n // ROW)
    padded = np.full(rows * ROW, BREAK, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(rows, ROW).T).astype(np.uint16) * 16
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for column in steps:
        maps = STEP.take(column[:, None] + maps)
    # prefixes of the rows' functions, doubling the number of rows composed
    reach = 1
    while reach < rows:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = START, maps[:-1, START]
    states = np.empty((ROW, rows), np.uint8)
    for place, column in enumerate(steps):
        state = STEP.take(column + state)
        states[place] = state
    return states.T.ravel()[:n]


def starts(kinds: np.ndarray) -> np.ndarray:
    """Whether a token starts at each character. ``kinds`` begins and ends with a break."""
    states = scan(kinds)
    before, now, after = states[:-2], states[1:-1], states[2:]
    white = (now == AT_BLANK) | (now == AT_SPACE)
    was_white = (before == AT_BLANK) | (before == AT_SPACE)
    # the last of several white characters, or the only one, stands at the head of what follows it
    next_solid = (after != AT_BLANK) & (after != AT_SPACE) & (after != START)
    begin = white & (~was_white | next_solid)
    letter = (now == IN_LETTERS) & (before != IN_LETTERS) & (before != AFTER_RV) & (before != AFTER_ELL)
    # a contraction that comes to nothing: its letter begins a run
    failed = ((now == AFTER_RV) | (now == AFTER_ELL)) & (after != CONTRACTED)
    number = (now == IN_NUMBERS) & (before != IN_NUMBERS)
    other = (now == IN_OTHERS) & (before != IN_OTHERS) & (before != AT_QUOTE)
    begin |= (letter | number | other) & (before != AT_BLANK)
    return begin | failed | (now == AT_QUOTE)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHARS characters together."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text) + 1
        if size >= CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


#: Where one token ends and another begins, whatever stands around: before white space, after anything else.
SURE_CUT = re.compile(f"(?<=[^{''.join(map(chr, WHITE))}])(?=[{''.join(map(chr, WHITE))}])")


def parts(text: str) -> Iterator[str]:
    """A long text in parts of about CHARS characters, cut only where tokens part. Text without white space is not cut."""
    start = 0
    while len(text) - start > CHARS:
        cut = SURE_CUT.search(text, start + CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _slices(texts: list[str], table: np.ndarray) -> Iterator[tuple[bytes, list[int]]]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) + 1
    points = np.full(int(lengths.sum()) + len(texts) + 1, 0x110000, np.uint32)
    for text, first in zip(texts, firsts.tolist()):
        points[first : first + len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    begin = starts(table.take(points))
    widths = np.ones(len(points), np.int64)
    for least in (0x80, 0x800, 0x10000):
        widths += points >= least
    widths[points == 0x110000] = 0
    offsets = np.cumsum(widths) - widths
    places = np.flatnonzero(begin) + 1
    cuts = np.searchsorted(places, np.append(firsts, len(points)))
    where = offsets[places]
    for i, text in enumerate(texts):
        data = text.encode()
        yield data, [*(where[cuts[i] : cuts[i + 1]] - offsets[firsts[i]]).tolist(), len(data)]


#: Slices of at most so many bytes are merged side by side; longer ones one by one.
SHORT = 64
NONE = (1 << 31) - 1


class PairRanks:
    """Rank of the token that two neighbouring tokens make, looked up for whole arrays in an open hash table."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        splits = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(c, np.uint64) for c in zip(*splits)) if splits else (np.zeros(0, np.uint64),) * 3
        self.bits = max(4, int(np.ceil(np.log2(2 * len(left) + 1))) + 1)
        self.keys = np.full(1 << self.bits, (1 << 64) - 1, np.uint64)
        self.found = np.full(1 << self.bits, NONE, np.int32)
        keys = left << np.uint64(32) | right
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == np.uint64((1 << 64) - 1)
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.found[at[placed]] = rank[todo[placed]]
            todo, at = todo[~placed], at[~placed] + 1 & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._home(keys)
        out = self.found[at]
        held = self.keys[at]
        todo = np.flatnonzero(held != keys)
        out[todo] = NONE
        todo = todo[held[todo] != np.uint64((1 << 64) - 1)]
        at = at[todo]
        while len(todo):
            at = at + 1 & (1 << self.bits) - 1
            held = self.keys[at]
            same = held == keys[todo]
            out[todo[same]] = self.found[at[same]]
            on = ~same & (held != np.uint64((1 << 64) - 1))
            todo, at = todo[on], at[on]
        return out


class Vocabulary:
    """Ranks of byte strings, with the ids of recent slices."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens])
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairRanks(self.ranks)
        self.recent: dict[bytes, tuple[int, ...]] = {}
        self.held = 0

    def learn(self, pieces: list[bytes]) -> None:
        """Work out the ids of slices and remember them."""
        short: list[bytes] = []
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                self.recent[piece] = (whole,)
            elif len(piece) > SHORT:
                self.recent[piece] = self.merged(piece)
            else:
                short.append(piece)
        for at in range(0, len(short), 1 << 12):
            self._merge_side_by_side(short[at : at + (1 << 12)])
        self.held += sum(ENTRY_BYTES + len(piece) + ID_BYTES * len(self.recent[piece]) for piece in pieces)

    def forget(self, pieces: list[bytes]) -> None:
        """Drop long slices, which seldom come again, and all slices once they take too much."""
        if self.held > REMEMBERED_BYTES:
            self.recent.clear()
            self.held = 0
            return
        for piece in pieces:
            if len(piece) > SHORT:
                self.held -= ENTRY_BYTES + len(piece) + ID_BYTES * len(self.recent.pop(piece))

    def _merge_side_by_side(self, pieces: list[bytes]) -> None:
        """One merge in every slice per round: that of its lowest pair, the leftmost if several are."""
        if not pieces:
            return
        ids = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        rank = np.full(len(ids), NONE, np.int32)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner] = self.pairs.of(ids[inner], ids[inner + 1])
        done_ids, done_own = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            sizes = np.diff(np.append(first, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            open_ = least < NONE
            if not open_.all():
                done_ids.append(ids[~open_])
                done_own.append(own[~open_])
                ids, own, rank, least = ids[open_], own[open_], rank[open_], least[open_]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least)
            at = at[np.concatenate(([True], own[at[1:]] != own[at[:-1]]))]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, own, rank = ids[keep], own[keep], rank[keep]
            rank[moved] = NONE
            after = moved[moved + 1 < len(ids)]
            after = after[own[after] == own[after + 1]]
            before = moved[moved > 0]
            before = before[own[before - 1] == own[before]] - 1
            for places in (after, before):
                rank[places] = self.pairs.of(ids[places], ids[places + 1])
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        flat, cuts = ids[order].tolist(), np.cumsum(np.bincount(own, minlength=len(pieces))).tolist()
        start = 0
        for piece, end in zip(pieces, cuts):
            self.recent[piece] = tuple(flat[start:end])
            start = end

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the pair of neighbours with the lowest rank is merged, the leftmost first, until none has one."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 512:
            return self._merged_long(piece)
        ranks, none = self.ranks, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return tuple([ranks[p] for p in parts])

    def _merged_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for very long slices, with a heap over linked parts."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n

        def push(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone] = False
            end[i] = stop
            if stop < n:
                left[stop] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return tuple(out)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts together are of bounded length."""
        found = self.recent
        cut = [[data[a:b] for a, b in zip(at, at[1:])] for data, at in _slices(texts, classes())]
        new = list(set().union(*cut).difference(found))
        self.learn(new)
        out = [np.fromiter(chain.from_iterable(map(found.__getitem__, pieces)), np.int32) for pieces in cut]
        self.forget(new)
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """UTF-8 bytes and ids of each text."""
        for group in _groups(texts):
            if len(group[-1]) <= CHARS:
                ids = self._ids(group)
            else:
                ids = self._ids(group[:-1]) if group[:-1] else []
                ids.append(np.concatenate([self._ids([part])[0] for part in parts(group[-1])]))
            yield from zip((text.encode() for text in group), ids)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token ends."""
        return np.cumsum(self.sizes[ids])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, loaded once in a worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


#: Characters of texts whose ids go into one batch.
BATCH_CHARS = 1 << 20


def _by_size(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts, null as empty, of about BATCH_CHARS together."""
    at, run, size = 0, [], 0
    for text in texts:
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= BATCH_CHARS:
            yield at, run
            at, run, size = at + len(run), [], 0
    if run:
        yield at, run


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, ranks_path: str, offsets: bool = True) -> DataFrame:
    """``row`` (all columns of ``docs``) with ``ids`` and, if asked for, ``ends``: the byte at which each token ends.

    The ids are those of ``encode_ordinary`` with the public pattern and the ranks. A null or empty text has none. Each row is encoded for
    itself, so repeated rows and null doc_ids change nothing.
    """
    names = ["row", "ids", "ends"][: 3 if offsets else 2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(ranks_path)
        for batch in batches:
            rows = batch.column(0)
            for at, texts in _by_size(rows.field(rows.type.get_field_index("text"))):
                ids = [found for _, found in own.encode(texts)]
                columns = [_list(ids)]
                if offsets:
                    columns.append(_list([own.ends(i).astype(np.int32) for i in ids]))
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(texts)), *columns], names)

    rows = docs.select(F.struct("*").alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>" + ", ends array<int>" * offsets
    return rows.mapInArrow(work, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded(row, ids, ...)`` with ``decoded``, the bytes of the ids: exactly the bytes of the text. Null ids give null."""
    names = encoded.columns
    place = names.index("ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(ranks_path)
        for batch in batches:
            found = [own.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None for ids in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(work, f"{schema}, decoded binary")


def ids_digest(ids: np.ndarray) -> str:
    """SHA-256 of the ids in decimals, joined by commas."""
    digest = hashlib.sha256()
    for at in range(0, len(ids), 1 << 16):
        digest.update(b"," * (at > 0) + ",".join(map(str, ids[at : at + (1 << 16)].tolist())).encode())
    return digest.hexdigest()


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs(doc_id, text, ...)``, in one pass.

    Each text is encoded as in ``encode``, its ids are decoded as in ``decode``, and only the digests of both leave the task. Other
    columns are not read. Nulls, empty texts and repeated rows as there.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(ranks_path)
        for batch in batches:
            for at, texts in _by_size(batch.column(1)):
                found = [ids for _, ids in own.encode(texts)]
                decoded = [hashlib.sha256(own.decode(ids.tolist())).hexdigest() for ids in found]
                columns = [pa.array(map(len, found), pa.int64()), pa.array(map(ids_digest, found)), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
