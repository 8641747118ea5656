"""SimHash near-deduplication with Golay-code fuzzy hashing.

A fingerprint is cut into segments.  The binary Golay code [23, 12, 7] is perfect: every 23-bit word has one codeword within
3 bits, whose 12-bit index is the segment's key.  The codewords of a segment and of all words one bit from it are its *ball*
keys, six or fewer; two segments at most two bits apart share one, for some word lies within one bit of both.

A table of keys joins two segments, each exactly or by its ball.  By the pigeonhole principle one of the tables sees any pair
of fingerprints within the radius (see ``Scheme``).  What shares a key is compared in full.  Equal fingerprints are one node
from the start.  A task compares a key's fingerprints block by block and passes on a spanning forest, never the pairs; a key
with more fingerprints than a block has its blocks paired in separate groups.

The pipeline's stage looks for far more differing bits than such tables cover.  Its tables are many, each of a segment's codeword
index and of other bits as they are, as many as it takes for a key to have few strangers (``similar``).  What they
find are candidates only: texts are linked if their sets of shingles are, compared exactly, similar enough (``similar_roots``).
Where candidates form a large group that isn't plainly one of copies, its sets are compared in blocks, as products of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Bloom, chosen_rows, cut, free_name, give_back, outside, read_table, scratch, spread_join
from .components import components

#: Fingerprints of one key that are compared in one group; two such blocks meet in a group of their own.
BLOCK = 4096
#: Rows of shingle hashes whose bits are unpacked at a time.
UNPACK = 1 << 16
#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GENERATOR = 0b101011100011


@dataclass(frozen=True)
class Scheme:
    """Segments as (first bit, width), tables as pairs of (segment, "exact" or "ball"), and the most differing bits.

    ``NEAR`` covers 3 bits of 64 fully: if every one of four segments in a ring that has no error were followed by one with two
    or more, there would be at least 2z + (4 - 2z) = 4 errors with z segments without any.  So some segment is the same and the
    next has one error at most.

    ``dealt`` are further tables, each a list of positions: the first 23 are a segment, whose codeword index is the key's first
    part, and the bits at the others are the second.
    """

    seeds: tuple[int, ...]
    segments: tuple[tuple[int, int], ...]
    tables: tuple[tuple[tuple[int, str], tuple[int, str]], ...]
    radius: int
    dealt: tuple[tuple[int, ...], ...] = ()


NEAR = Scheme((42,), tuple((16 * k, 16) for k in range(4)), tuple(((k, "exact"), ((k + 1) % 4, "ball")) for k in range(4)), 3)
#: Texts of the pipeline are near copies if their shingle sets share this part of their union or more: a numerator and a denominator.
ALIKE = (4, 5)
#: Bits of a word of the code and of a codeword's index.
WORD, INDEX = 23, 12
#: Each bit of fingerprints of sets at the limit of ``ALIKE`` differs with this chance: an angle whose cosine is 8/9, as a part of pi.
DIFFER = math.acos(2 * ALIKE[0] / (ALIKE[0] + ALIKE[1])) / math.pi
#: The share of such pairs that is to have a key in common, and the strangers that a fingerprint may meet in a table on the average.
RECALL, STRANGERS = 0.99, 8
#: Dealt tables whose keys are made and compared at a time: so many rows of 40 bytes a fingerprint are on disk at once, however many tables there are.
ROUND = 32
#: Sets and hashes that a block of them has on the average at most (a set alone can have more), and columns of a matrix at a time.
SETS, HASHES, COLUMNS = 512, 1 << 20, 2048


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each 12-bit message's shifted word, and the error of each 11-bit syndrome."""
    remainder = np.arange(1 << 12, dtype=np.uint32) << 11
    for bit in range(22, 10, -1):
        remainder = np.where(remainder >> bit & 1, remainder ^ (GENERATOR << (bit - 11)), remainder)
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    errors = np.concatenate(([0], one, [a | b for i, a in enumerate(one) for b in one[:i]], [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]])).astype(np.uint32)
    table = np.zeros(1 << 11, np.uint32)
    table[remainder[errors >> 11] ^ (errors & 0x7FF)] = errors
    return remainder, table


def codeword_index(words: np.ndarray) -> np.ndarray:
    remainder, errors = golay_tables()
    return (words ^ errors[remainder[words >> 11] ^ (words & 0x7FF)]) >> 11


def ball_keys(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word and its neighbours, sorted, and which of them are the first of their kind in the row."""
    flips = np.concatenate(([0], np.uint32(1) << np.arange(width, dtype=np.uint32))).astype(np.uint32)
    keys = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


@cache
def same_index_chances() -> np.ndarray:
    """How likely two words that differ in so many bits have the same codeword."""
    rng, n = np.random.RandomState(1), 20_000  # its stream never changes
    words = rng.randint(0, 1 << WORD, n).astype(np.uint32)
    order = rng.random_sample((n, WORD)).argsort(axis=1)
    other = [words ^ ((order < k) << np.arange(WORD)).sum(axis=1).astype(np.uint32) for k in range(WORD + 1)]
    return np.array([(codeword_index(words) == codeword_index(x)).mean() for x in other])


@cache
def tables_for(bits: int, of: int) -> int:
    """How many tables with keys of so many bits it takes for ``RECALL``, over all numbers of bits in which a pair at the limit may differ."""
    share, chance = np.zeros(of + 1), np.zeros(of + 1)
    for d in range(of + 1):
        share[d] = math.comb(of, d) * DIFFER**d * (1 - DIFFER) ** (of - d)
        in_word = [math.comb(d, k) * math.comb(of - d, WORD - k) / math.comb(of, WORD) for k in range(WORD + 1)]
        chance[d] = np.dot(in_word, same_index_chances()) * (1 - d / of) ** (bits - INDEX)
    tables = 1
    while (share * (1 - (1 - chance) ** tables)).sum() < RECALL:
        tables += max(1, tables // 50)
    return tables


@cache
def similar(rows: int) -> Scheme:
    """Candidates for a similarity of ``ALIKE`` of shingle sets, among so many fingerprints.

    Keys have as many bits as it takes for a fingerprint to meet ``STRANGERS`` others in a table or fewer, if these have nothing in
    common: so the pairs compared grow with the fingerprints and not with their square.  Wider keys agree less often, and the
    tables that it takes instead grow with less than the fourth root of the rows.  Pairs at the limit differ in 29 of 192 bits on
    the average, with a standard deviation of 5; a radius of 46 is 3.4 of these above.
    """
    seeds, orders, bits = (0, 1, 2), np.random.RandomState(1), INDEX
    while rows > STRANGERS << bits:
        bits += 1
    size, n, tables = WORD + bits - INDEX, tables_for(bits, 64 * len(seeds)), []
    while len(tables) < n:
        order = orders.permutation(64 * len(seeds)).tolist()
        tables += [tuple(order[at : at + size]) for at in range(0, len(order) - size + 1, size)]
    return Scheme(seeds, (), (), 46, tuple(tables[:n]))


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white space characters
    if not words:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = max(1, len(words) - width + 1)
    ends = (starts + lengths)[min(width, len(words)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> bytes:
    """A little-endian 64-bit word: a bit is 1 if set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), UNPACK):
        part = hashes[at : at + UNPACK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").tobytes()


def simhash(text: bytes, width: int, seeds: tuple[int, ...]) -> bytes:
    """A word for each seed; repeats of a shingle count each time."""
    return b"".join(majority(shingle_hashes(text, width, seed)) for seed in seeds)


def mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles for each number: the finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(width: int, seeds: tuple[int, ...]):
    """The column function; a null text has no words and the fingerprint zero."""

    @F.arrow_udf("binary")
    def of(text: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), width, seeds) for t in text.cast(pa.binary()).fill_null(b"")], pa.binary())

    return of


def key_rows(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """``(key, fp)`` for each key of each fingerprint."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 2000):
                fps = words_of(whole.column(0).slice(at, 2000))
                for number, keys in enumerate(dealt_keys(fps, scheme)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.int64(number) << 48 | keys), binary(fps)], ["key", "fp"])
                segments = [segment(fps, *s) for s in scheme.segments]
                balls = {s: ball_keys(segments[s], scheme.segments[s][1]) for t in scheme.tables for s, how in t if how == "ball"}
                exact = {s: (segments[s][:, None], np.ones((len(fps), 1), bool)) for t in scheme.tables for s, how in t if how == "exact"}
                for number, ((a, how_a), (b, how_b)) in enumerate(scheme.tables):
                    keys_a, first_a = (balls if how_a == "ball" else exact)[a]
                    keys_b, first_b = (balls if how_b == "ball" else exact)[b]
                    keys = np.int64(number) << 56 | keys_a.astype(np.int64)[:, :, None] << 24 | keys_b.astype(np.int64)[:, None, :]
                    row, i, j = np.nonzero(first_a[:, :, None] & first_b[:, None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row, i, j]), binary(fps[row])], ["key", "fp"])
        give_back()

    return nodes.select("fp").mapInArrow(batches, "key long, fp binary")


def sizes_of(fps: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The sizes of the fingerprints' sets; 0 where none is known."""
    n = len(scheme.seeds)
    return (fps[:, n] & SIZE).astype(np.int32) if fps.shape[1] > n else np.zeros(len(fps), np.int32)


def dealt_keys(fps: np.ndarray, scheme: Scheme) -> Iterator[np.ndarray]:
    """For each dealt table every row's key."""
    bits = np.unpackbits(np.ascontiguousarray(fps[:, : len(scheme.seeds)]).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    for positions in scheme.dealt:
        number = lambda at: bits[:, at] @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
        index = codeword_index(number(positions[:WORD]).astype(np.uint32)).astype(np.int64)
        yield index << (len(positions) - WORD) | number(positions[WORD:])


def words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def binary(fps: np.ndarray) -> pa.Array:
    size = fps.shape[1] * 8
    fixed = pa.Array.from_buffers(pa.binary(size), len(fps), [None, pa.py_buffer(np.ascontiguousarray(fps).tobytes())])
    return fixed.cast(pa.binary())


def segment(fps: np.ndarray, first: int, width: int) -> np.ndarray:
    word, at = divmod(first, 64)
    bits = fps[:, word] >> np.uint64(at)
    if at + width > 64:
        bits = bits | fps[:, word + 1] << np.uint64(64 - at)
    return (bits & np.uint64((1 << width) - 1)).astype(np.uint32)


def close(fps: np.ndarray, a: np.ndarray, b: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Whether rows ``a`` and ``b`` differ in few bits; if a word with the sets' sizes follows the bits, also whether these allow for ``ALIKE``."""
    n = len(scheme.seeds)
    near = np.bitwise_count(fps[a, :n] ^ fps[b, :n]).sum(axis=1) <= scheme.radius
    if fps.shape[1] > n:
        x, y = fps[a, n] & SIZE, fps[b, n] & SIZE
        near &= ALIKE[1] * np.minimum(x, y) >= ALIKE[0] * np.maximum(x, y)
    return near


def forest(keys: np.ndarray, fps: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and their roots: a forest that spans, within each run of equal keys, what is linked.

    Where sizes are known, a run is taken in their order, and no row is compared with larger ones than ``ALIKE`` allows for.
    """
    order, sizes = np.arange(len(keys)), sizes_of(fps, scheme).astype(np.int64)
    if scheme.dealt:
        order = np.lexsort((sizes, keys))
        keys, fps, sizes = keys[order], fps[order], sizes[order]
    parent = np.arange(len(keys))
    most = sizes * ALIKE[1] // ALIKE[0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, shift = np.arange(len(keys) - 1), 1
    while len(left := left[left + shift < len(keys)]) and len(left := left[(keys[left + shift] == keys[left]) & (sizes[left + shift] <= most[left])]):
        near = left[parent[left] != parent[left + shift]]
        near = near[close(fps, near, near + shift, scheme)]
        for i in near.tolist():
            a, b = find(i), find(i + shift)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(near):
            while (parent != (up := parent[parent])).any():
                parent = up
        shift += 1
    linked = np.nonzero(parent != np.arange(len(keys)))[0]
    yield order[linked], order[parent[linked]]


COMPARED = "u binary, v binary, key long, block int"


def compare(keyed: DataFrame, scheme: Scheme, block: int = BLOCK) -> DataFrame:
    """Edges ``(u, v)`` of ``(key, fp)`` rows as ``by_key`` gives them; of a key with over a block of rows, all rows as ``(u, key, block)``."""

    def edges(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in forest(keys, fps, scheme):
            yield pa.RecordBatch.from_arrays([binary(fps[i]), binary(fps[j]), pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32())], ["u", "v", "key", "block"])

    def as_block(key: int, number: int, fps: np.ndarray) -> pa.RecordBatch:
        m = len(fps)
        return pa.RecordBatch.from_arrays([binary(fps), pa.nulls(m, pa.binary()), pa.array(np.full(m, key)), pa.array(np.full(m, number), pa.int32())], ["u", "v", "key", "block"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), None
        blocks: dict[int, int] = {}  # blocks so far of the key that goes on

        def wide(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            key = int(k[0])
            for at in range(0, len(k), block):
                part = slice(at, at + block)
                yield from edges(k[part], f[part])
                yield as_block(key, blocks.setdefault(key, 0), f[part])
                blocks[key] += 1

        for whole in chain(rows, [None]):
            if whole is not None and whole.num_rows:
                more = words_of(whole.column(1))
                fps = np.concatenate((fps, more)) if len(keys) else more
                keys = np.concatenate((keys, whole.column(0).to_numpy()))
            if not len(keys):
                continue
            end = len(keys) if whole is None else int(np.searchsorted(keys, keys[-1]))
            k, f = keys[:end], fps[:end]
            starts = np.concatenate(([0], np.nonzero(k[1:] != k[:-1])[0] + 1)) if end else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, end))
            large = (sizes > block) | np.isin(k[starts], list(blocks))
            several = np.repeat(~large & (sizes > 1), sizes)
            if several.any():
                yield from edges(k[several], f[several])
            for i in np.nonzero(large)[0]:
                run = slice(starts[i], starts[i] + sizes[i])
                yield from wide(k[run], f[run])
            keys, fps = keys[end:], fps[end:]
            if end:
                blocks.clear()
            if len(keys) > block:
                full = len(keys) // block * block
                yield from wide(keys[:full], fps[:full])
                keys, fps = keys[full:], fps[full:]
        give_back()

    return keyed.mapInArrow(batches, COMPARED)


def by_key(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key")


def edges_of(nodes: DataFrame, scheme: Scheme, label: str, block: int = BLOCK) -> DataFrame:
    """``(u, v)``: for every key a spanning forest's edges, over distinct fingerprints."""
    if len(scheme.dealt) > ROUND:  # tables by turns, so that the keys of a few are there at a time
        turns = [replace(scheme, dealt=scheme.dealt[at : at + ROUND]) for at in range(0, len(scheme.dealt), ROUND)]
        return reduce(DataFrame.unionByName, [edges_of(nodes, turn, label, block) for turn in turns])
    keyed = key_rows(nodes, scheme)
    found = cut(compare(by_key(keyed), scheme, block), f"{label}-compared")
    edges = found.filter("v is not null").select("u", "v")
    wide = found.filter("v is null").select("key", "block", F.col("u").alias("fp"))
    if wide.isEmpty():
        return edges
    # Keys with over a block of fingerprints: every two of their blocks meet in a group of their own.
    others = wide.groupBy("key").agg(F.max("block").alias("last")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    met = wide.join(others, "key").filter("other <> block")
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    again = compare(by_key(met.select(pair.alias("key"), "fp")), scheme, 1 << 30)
    return edges.unionByName(cut(again, f"{label}-blocks").select("u", "v"))


def link(rows: DataFrame, scheme: Scheme, label: str = "simhash", block: int = BLOCK) -> DataFrame:
    """``(fp, root)`` of every distinct fingerprint of ``rows``; root is the smallest fingerprint of its component."""
    nodes = cut(rows.select("fp").distinct(), f"{label}-nodes")
    roots = components(edges_of(nodes, scheme, label, block), f"{label}-components")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, width: int = 3, scheme: Scheme = NEAR, label: str = "simhash", block: int = BLOCK) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)``, a row for each row of ``docs``.

    component_id is the smallest doc_id reachable, null only where all are null.  Texts that are null or have no word share the
    fingerprint zero and link like any others; repeated rows are one node; an empty table gives an empty one.  Texts of any length
    are read whole, in time that grows with it; other columns are left out, so their names can't clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(rows.select("doc_id", text_hash(F.col("text")).alias("text_hash"), fingerprint(width, scheme.seeds)("text").alias("fp")), f"{label}-fingerprints")
    with scratch():
        roots = cut(link(rows, scheme, label, block), f"{label}-roots")
        smallest = rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")).join(roots, "fp")
        ids = smallest.groupBy("root").agg(F.min("smallest").alias("component_id"))
        with outside():
            classes = cut(roots.join(ids, "root").select("fp", "root", "component_id"), f"{label}-classes")
    return spread_join(rows, classes, "fp", label=label)


def text_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart without another fingerprint; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: The bits of a node's last word that hold the number of its shingles, at most this; the others are of a hash of the set.
SIZE = np.uint64((1 << 24) - 1)


#: Its seeds and radius are those of every number of rows.
SIMILAR = similar(1)


def set_node(text: bytes, width: int, scheme: Scheme) -> bytes:
    """The fingerprint of the shingle set, then a word of its hash and size: texts with the same set are one node."""
    own = shingle_set(text, width)
    tail = xxhash.xxh64_intdigest(own.tobytes()) & ~int(SIZE) | min(len(own), int(SIZE))
    return b"".join(majority(mixed(own, number)) for number in scheme.seeds) + tail.to_bytes(8, "little")


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width, 42))


def alike(a: bytes, b: bytes) -> bool:
    """Whether two sorted sets of hashes are similar enough; exact, in whole numbers.  Empty sets are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(x) + len(y) - both)


def common_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many hashes each of the first ``left`` sets shares with each of the others, or with each of all if there are no others."""
    n = len(sets)
    right = slice(left, n) if left < n else slice(0, n)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts[column] > 1  # a hash that one set has is no common one
    owner, column = owner[several], column[several]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.diff(column[order], prepend=-1) > 0) - 1
    out = np.zeros((left, right.stop - right.start), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[part], column[part] - first] = 1
        out += has[:left] @ has[right].T  # whole numbers below 2^24
    if left == n:
        np.fill_diagonal(out, [len(x) for x in sets])
    return out.astype(np.int64)


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the least row of its component."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root, len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def on_texts(of, kind: str):
    """The column function of ``of`` over texts as bytes, null as the empty one."""

    @F.arrow_udf(kind)
    def column(text: pa.Array) -> pa.Array:
        made = pa.array([of(t.as_py()) for t in text.cast(pa.binary()).fill_null(b"")], pa.binary())
        give_back()
        return made

    return column


def on_sets():
    """The column function of ``alike``."""

    @F.arrow_udf("boolean")
    def column(a: pa.Array, b: pa.Array) -> pa.Array:
        judged = pa.array([alike(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_())
        give_back()
        return judged

    return column


def size_of(fp: Column) -> Column:
    """The size that stands in a node's last word: its three lowest bytes, which come first."""
    digits = F.hex(F.substring(fp, -8, 3))
    return F.conv(F.concat(F.substring(digits, 5, 2), F.substring(digits, 3, 2), F.substring(digits, 1, 2)), 16, 10).cast("long")


def in_steps(members: DataFrame, sets: int = SETS, hashes: int = HASHES) -> DataFrame:
    """``(group, low, high, below, own, fp, of)``: each row of ``members`` ``(group, fp, linked, of)`` once for every block that its own one meets.

    A group's sets are dealt to steps by their size, a step's largest being 5/4 of its smallest, and those of a step to blocks; sets
    that are alike stand in the same step or neighbouring ones.  Blocks of sets that are linked already don't meet each other.
    """
    ratio = F.lit(ALIKE[1] / ALIKE[0])
    step = F.floor(F.log(F.greatest(size_of(F.col("fp")), F.lit(1)).cast("double")) / F.log(ratio) + 1e-9).cast("int")
    sized = members.withColumn("step", step)
    most = F.greatest(F.lit(1), F.least(F.lit(sets), F.floor(F.lit(hashes) / F.pow(ratio, F.col("step") + 1))))
    counts = sized.groupBy("group", "step", "linked").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / most).cast("int")).drop("n")
    sides = counts.select("group", "step", "linked", "blocks", F.explode(F.expr("array(step - 1, step, step + 1)")).alias("other_step"))
    others = counts.select("group", F.col("step").alias("other_step"), F.col("linked").alias("other_linked"), F.col("blocks").alias("other_blocks"))
    meets = sides.join(others, ["group", "other_step"]).filter("not (linked and other_linked)")
    meets = meets.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))).drop("other_blocks")
    here = F.struct("step", "linked", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("block"))
    there = F.struct(F.col("other_step").alias("step"), F.col("other_linked").alias("linked"), F.col("other_block").alias("block"))
    placed = sized.join(meets, ["group", "step", "linked"]).select("group", here.alias("at"), there.alias("there"), "fp", "of")
    return placed.select("group", F.least("at", "there").alias("low"), F.greatest("at", "there").alias("high"), (F.col("at") < F.col("there")).alias("below"), (F.col("at") == F.col("there")).alias("own"), "fp", "of")


def compared_in_blocks(members: DataFrame, sets: int = SETS, hashes: int = HASHES) -> DataFrame:
    """``(u, v)``: for every two blocks of ``in_steps`` that meet, each set with the first of those that it is linked with there."""

    def forest_of(table: pa.Table) -> pa.Table:
        own = table["own"][0].as_py()
        table = table.sort_by([("below", "descending")])
        left = table.num_rows if own else sum(table["below"].to_pylist())
        of = [np.frombuffer(x, np.uint64) for x in table["of"].to_pylist()]
        sizes = np.array([len(x) for x in of])
        n, right = len(of), slice(0 if own else left, len(of))
        both = common_counts(of, left)
        near = ALIKE[1] * both >= ALIKE[0] * (sizes[:left, None] + sizes[None, right] - both)
        linked = np.zeros((n, n), bool)
        linked[:left, right] = near
        root = spanning(linked | linked.T)
        at = np.nonzero(root != np.arange(n))[0]
        fps = table["fp"].combine_chunks()
        return pa.table({"u": fps.take(pa.array(at)), "v": fps.take(pa.array(root[at]))})

    return in_steps(members, sets, hashes).groupBy("group", "low", "high").applyInArrow(forest_of, "u binary, v binary")


def similar_roots(rows: DataFrame, docs: DataFrame, width: int, label: str) -> DataFrame:
    """``(fp, root)`` of the nodes of ``rows``: components of the candidate pairs whose shingle sets are alike.

    Candidates are first taken for links.  Each member of such a coarse component is compared with its smallest; where all are
    alike, the component stands.  In the others those that aren't are compared with each other and with the rest.
    """
    nodes = cut(rows.select("fp").distinct(), f"{label}-nodes")
    coarse = cut(components(edges_of(nodes, similar(nodes.count()), label), f"{label}-coarse"), f"{label}-stars")
    # The smallest of a large component stands in as many places as it takes, so that no task has all its members.
    parts = coarse.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    nodes_of = coarse.join(parts, "root").select(F.col("node").alias("fp"), "root", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "parts")
    members = cut(nodes_of.unionByName(parts.select(F.col("root").alias("fp"), "root", F.lit(0).alias("part"), "parts")), f"{label}-members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "copies")
    every = rows.groupBy("fp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    chosen = every.groupBy("fp").agg(F.min(order).alias("o"))
    chosen = cut(chosen.join(members, "fp").select("fp", "root", "part", "parts", "o.doc_id", "o.text_hash", "o.copies"), f"{label}-chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).withColumn("hash", text_hash(F.col("text")))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    # Only the texts of candidates, and a few others, are shuffled.
    likely = Bloom(chosen, "doc_id", "text_hash").may_have("id", "hash")
    found = texts.filter(likely).join(chosen.hint("merge"), same).select("fp", "root", "part", "parts", "text")
    if not chosen.filter("copies > 1").isEmpty():
        found = found.dropDuplicates(["fp"])
    made = on_texts(lambda t: shingle_set(t, width).tobytes(), "binary")("text").alias("of")
    sets = cut(found.select("fp", "root", "part", "parts", made), f"{label}-sets")

    # A set comes with its component, so that only this join shuffles it to its smallest.
    centres = sets.filter("fp = root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("of").alias("b"))
    stars = sets.filter("fp <> root").select(F.col("fp").alias("node"), "root", "part", F.col("of").alias("a")).join(centres, ["root", "part"])
    stars = cut(stars.select("node", "root", on_sets()("a", "b").alias("alike")), f"{label}-judged")
    links = stars.filter("alike").select(F.col("node").alias("u"), F.col("root").alias("v"))
    open_roots = cut(stars.filter("not alike").select("root").distinct(), f"{label}-open")
    if not open_roots.isEmpty():
        pool = stars.join(open_roots, "root", "left_semi").select(F.col("root").alias("group"), F.col("node").alias("fp"), F.col("alike").alias("linked"))
        pool = pool.unionByName(open_roots.select(F.col("root").alias("group"), F.col("root").alias("fp"), F.lit(True).alias("linked")))
        links = links.unionByName(cut(compared_in_blocks(cut(pool.join(sets.select("fp", "of"), "fp"), f"{label}-pool")), f"{label}-forests"))
    roots = components(links, f"{label}-components")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, width: int = 5, label: str = "simhash-stage") -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest doc_id, nulls last; rows that tie stay once.

    Texts that are null or have no word are one group.  All columns stay as they are; an empty table gives an empty one.
    """
    id_, hash_ = free_name(docs, "_id"), free_name(docs, "_hash")
    with scratch():
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        node = on_texts(lambda t: set_node(t, width, SIMILAR), "binary")("text").alias("fp")
        made = cut(texts.select("doc_id", text_hash(F.col("text")).alias("text_hash"), node), f"{label}-fingerprints")
        rows = spread_join(made, cut(similar_roots(made, docs, width, label), f"{label}-roots"), "fp", label=label)
        rows = cut(rows.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")), f"{label}-rows")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
        firsts = rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), F.lit(True).alias("stays"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
        keys = rows.join(firsts, same, "left").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), "stays", "copies")
        with outside():
            keys = cut(keys, f"{label}-keys")
    marked = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(hash_, text_hash(F.col("text").cast("string")))
    return chosen_rows(marked, (id_, hash_), keys.filter("stays"), keys.filter("stays is null"), label).drop(id_, hash_)


def big_endian_hex(fp: Column) -> Column:
    """The 16 hex digits of 8 little-endian bytes; Spark's ``reverse`` takes bytes for UTF-8 characters."""
    digits = F.lower(F.hex(fp))
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", big_endian_hex(F.col("fp")).alias("fingerprint"), "component_id")
