"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles, hashed to 64 bits; 64 bits of a digest stand for a set in buckets, and 128 bits
wherever sets count as equal. Two link when ``den * |x & y| >= num * |x | y|``.

1. One pass makes each document's set size, set digest and *segment signatures*. A set is dealt by hash into so many
   segments that two linked sets, whatever they are, agree on a segment that isn't empty: linked sets of at most s
   shingles differ in at most ``2 s (den - num) / (den + num)`` of them, and there is one segment more than that, plus
   spares for segments that are empty. (A set with more empty segments than spares signs its empty ones too; so does
   every partner of it.) Sizes fall into bands of ratio num/den and sign for their own band and the next, as partners'
   bands are neighbours.
2. Sets that share a signature are a bucket; buckets of the same sets are taken as one. A bucket's sets, as sizes and
   token bitmaps alone, make a *signature tree*: sets sorted by size fill leaves, and every node holds its sets' size
   range, the OR of their bitmaps and the most tokens that share bits. A traversal of node pairs drops a pair when its
   sizes, or the most overlap that its bitmaps allow, can't link, or when all its sets are joined already. What is left
   joins sets that may link, and the connected parts of that graph are *blocks*: linked sets are always in one block.
   No pairs are listed; a bucket adds one edge a set.
3. Each block of two sets or more gets its texts again, once for each different set, and becomes a signature tree in
   its turn, whose pairs of leaves are checked exactly. A block over ``BLOCK_TOKENS``, or a bucket over
   ``BUCKET_TOKENS``, is dealt into parts, and each pair of parts is a task of its own.
4. Links make components; a document's component is the smallest id that it reaches.

Equal sets are one node throughout (``rep``), so copies cost one row each. Null or empty text has an empty set and is
linked with nothing. Ties and repeated rows have equal sets. Rows with a null id are left out. Only the id and text
columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm.arrow import map_arrow, map_batches, schema_of, utf8
from larkspur.llm.components import connected
from larkspur.llm.hot import hot_keys, split
from larkspur.llm.scratch import Scratch
from larkspur.llm.words import U, hashed_texts, mix, shingles

#: Tokens of one tree: a block with more is dealt into parts, and so is a bucket, whose trees hold bitmaps alone.
BLOCK_TOKENS, BUCKET_TOKENS = 1_000_000, 8_000_000
LEAF, FANOUT = 16, 8
#: Sets whose signatures were written already by this task, so that copies add none; only saves work.
SEEN = 200_000


class Bands:
    """Size bands and their segment counts for the threshold num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts, self._plan = num, den, [1], {}

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def plan(self, g: int) -> tuple[int, int]:
        """Segments and spares of band ``g``, which compares sizes of bands g - 1 and g."""
        if g not in self._plan:
            while len(self.starts) <= g + 1:
                self.starts.append(self.starts[-1] * self.den // self.num + 1)
            least, most = self.starts[max(0, g - 1)], self.starts[g + 1] - 1
            segments = 2 * most * (self.den - self.num) // (self.den + self.num) + 1
            empty = segments * exp(-least / segments)
            spare = ceil(empty + 3 * sqrt(empty)) if segments > 1 else 0
            self._plan[g] = (segments + spare, spare)
        return self._plan[g]


@lru_cache
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """The segment signatures of a set of hashed shingles."""
    by, out = bands(num, den), []
    own = by.of(len(tokens))
    spread = mix(tokens ^ U(0x5BD1E9955BD1E995))
    for g in (own, own + 1):
        segments, spare = by.plan(g)
        at = ((tokens >> U(32)) * U(segments) >> U(32)).astype(np.int64)
        sums, filled = np.zeros(segments, U), np.zeros(segments, bool)
        np.add.at(sums, at, spread)
        filled[at] = True
        which = np.flatnonzero(filled) if segments - np.count_nonzero(filled) <= spare else np.arange(segments)
        out.append(mix(sums[which] ^ mix(which.astype(U) + U(g << 32))))
    return np.concatenate(out)


class Forest:
    """Union of numbered sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Two bits or more for each token, a power of two in all, as 64-bit words; token bits are its lowest."""
    width = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    out = np.zeros(width // 64, U)
    at = (tokens & U(width - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, U(1) << (at & 63).astype(U))
    return out


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same tokens at a smaller width."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class Tree:
    """Signature tree over sets of given sizes and bitmaps; ``links`` joins all that ``check`` finds linked."""

    def __init__(self, sizes: list[int], bitmaps: list[np.ndarray], num: int, den: int, check=None):
        self.num, self.den, self.check = num, den, check
        words = min(map(len, bitmaps))
        maps = np.array([folded(m, words) for m in bitmaps])
        self.order = sorted(range(len(sizes)), key=lambda i: (sizes[i], maps[i, 0]))
        self.maps, self.sizes = maps[self.order], np.array(sizes)[self.order]
        self.shared = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        # levels[0] are leaves; a node is (least size, most size, OR of bitmaps, most tokens sharing bits)
        self.levels, step = [], LEAF
        while True:
            cut = np.arange(0, len(sizes), step)
            self.levels.append((np.minimum.reduceat(self.sizes, cut), np.maximum.reduceat(self.sizes, cut), np.bitwise_or.reduceat(self.maps, cut, axis=0), np.maximum.reduceat(self.shared, cut)))
            if len(cut) == 1:
                break
            step *= FANOUT

    def members(self, level: int, k: int) -> range:
        step = LEAF * FANOUT**level
        return range(k * step, min(len(self.sizes), (k + 1) * step))

    def can(self, least: np.ndarray, most: np.ndarray, other_least: int, other_most: int, overlap: np.ndarray) -> np.ndarray:
        """Whether sets of these sizes with at most this overlap may link."""
        overlap = np.minimum(np.minimum(overlap, most), other_most)
        small = least + other_least
        return (self.den * np.minimum(most, other_most) >= self.num * np.maximum(least, other_least)) & ((self.num + self.den) * overlap >= self.num * small)

    def links(self, forest: Forest, left: set[int] | None = None) -> None:
        """Dual traversal. With ``left`` (members of one of two parts), only pairs across the parts count."""
        self.forest, self.left = forest, left
        for leaf in range(len(self.levels[0][0])):
            self.pair(0, leaf, leaf)
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                if a != b:
                    self.pair(0, a, b)
                continue
            if self.joined(level, a, b):
                continue
            least, most, maps, shared = self.levels[level - 1]
            kids = lambda k: range(k * FANOUT, min(len(least), (k + 1) * FANOUT))
            others = np.array(kids(b))
            for x in kids(a):
                y = others[others >= x] if a == b else others
                if len(y):
                    overlap = np.bitwise_count(maps[y] & maps[x]).sum(1, dtype=np.int64) + np.minimum(shared[y], shared[x])
                    good = self.can(least[y], most[y], least[x], most[x], overlap)
                    stack += [(level - 1, x, int(k)) for k in y[good]]

    def joined(self, level: int, a: int, b: int) -> bool:
        root = None
        for k in (a, b):
            for i in self.members(level, k):
                r = self.forest.find(self.order[i])
                if root is None:
                    root = r
                elif r != root:
                    return False
        return True

    def pair(self, level: int, a: int, b: int) -> None:
        first, second = self.members(level, a), self.members(level, b)
        for i in first:
            others = np.arange(max(second.start, i + 1), second.stop)
            if not len(others):
                continue
            overlap = np.bitwise_count(self.maps[others] & self.maps[i]).sum(1, dtype=np.int64) + np.minimum(self.shared[others], self.shared[i])
            for j in others[self.can(self.sizes[others], self.sizes[others], self.sizes[i], self.sizes[i], overlap)]:
                x, y = self.order[i], self.order[int(j)]
                if self.left is not None and (x in self.left) == (y in self.left):
                    continue
                if self.forest.find(x) != self.forest.find(y) and (self.check is None or self.check(x, y)):
                    self.forest.join(x, y)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


def _profiles(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per document: id, set size, 128-bit digest of the set as (d1, d2), signatures and bitmap (none for a set seen before)."""
    kind = docs.schema["id"].dataType.simpleString()
    spark_schema = schema_of(f"id {kind}, n_shingles bigint, d1 bigint, d2 bigint, signs array<bigint>, bits binary")
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = [(t or b"").lower() for t in utf8(batch.column(1))]
            sizes, d1, d2, signs, bits = [], [], [], [], []
            for _, words in hashed_texts(texts):
                tokens = shingles(words, n)
                digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                sizes.append(len(tokens))
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & (1 << 64) - 1) - (1 << 63))
                if len(tokens) and digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    signs.append(signatures(tokens, num, den).view(np.int64))
                    bits.append(bitmap(tokens).tobytes())
                else:
                    signs.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signs, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=arrow_schema)

    return map_arrow(docs, run, spark_schema)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of sorted rows whose first ``keys`` columns are the key."""
    task, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != task:
                if len(held) > 1:
                    yield task, held
                task, held = row[:keys], []
            held.append(row[keys:])
    if len(held) > 1:
        yield task, held


def _solve(groups: DataFrame, keys: int, kind: str, forest_of) -> DataFrame:
    """(a, b) links from ``forest_of(key, rows)``, rows with their id first, in ascending order: each set to the least id it reaches there."""
    spark_schema = schema_of(f"a {kind}, b {kind}")
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b), arrow_schema, strict=True)], schema=arrow_schema)
        for key, rows in _groups(batches, keys):
            rows.sort(key=lambda r: r[0])
            forest = forest_of(key, rows)
            for k in range(len(rows)):
                r = forest.find(k)
                if rows[r][0] != rows[k][0]:
                    a.append(rows[k][0])
                    b.append(rows[r][0])
            if len(a) >= 10_000:
                yield made()
                a, b = [], []
        yield made()

    return map_arrow(groups, run, spark_schema)


def _across(task: tuple, rows: list[tuple]) -> set[int] | None:
    """The rows of the first of two different parts."""
    return {k for k, r in enumerate(rows) if r[1] == task[1]} if task[1] != task[2] else None


def _may_link(num: int, den: int):
    """Of rows (node, part, size, bitmap)."""

    def forest_of(task: tuple, rows: list[tuple]) -> Forest:
        forest = Forest(len(rows))
        Tree([r[2] for r in rows], [np.frombuffer(r[3], U) for r in rows], num, den).links(forest, _across(task, rows))
        return forest

    return forest_of


def _do_link(num: int, den: int):
    """Of rows (id, part, tokens)."""

    def forest_of(task: tuple, rows: list[tuple]) -> Forest:
        sets = [np.frombuffer(r[2], U) for r in rows]
        forest, left = Forest(len(rows)), _across(task, rows)
        Tree([len(x) for x in sets], [bitmap(x) for x in sets], num, den, lambda i, j: linked(sets[i], sets[j], num, den)).links(forest, left)
        return forest

    return forest_of


def _parted(s: Scratch, df: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """``df`` (group, member, n, ...) with parts and part: groups of more than ``most`` tokens in several, others in one."""
    big = df.groupBy(group).agg(F.sum("n").alias("tokens")).select(group, F.ceil(F.col("tokens") / most).cast("int").alias("parts")).filter("parts > 1")
    placed = df.join(s.write(big), group, "left").fillna(1, ["parts"])
    return placed.withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))


def _tasks(parted: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A row in each pair of parts that it belongs to: group, one, two, ``columns``; the rows of a task stand together."""
    with_ = parted.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = with_.select(group, F.least("with", "part").alias("one"), F.greatest("with", "part").alias("two"), *columns)
    return rows.repartition(group, "one", "two").sortWithinPartitions(group, "one", "two")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id of each document, and rep, the least id with an equal set."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    with Scratch(spark) as s:
        profiles = s.write(_profiles(rows, n, num, den))
        sets = s.write(profiles.filter("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n")))

        signs = profiles.filter("signs IS NOT NULL").select(F.col("d1").alias("node"), F.explode("signs").alias("sign"))
        # a signature that a large part of the sets share is aggregated, which combines before the shuffle; others meet
        hot = hot_keys(signs, "node", "sign")
        often, rest = split(signs, hot, "sign")
        of = Window.partitionBy("sign")
        whole = lambda over: (over(F.min("node")).alias("lo"), over(F.max("node")).alias("hi"), over(F.bit_xor(F.xxhash64("node"))).alias("all"))
        rest = rest.select("node", *whole(lambda c: c.over(of)))
        often = often.join(F.broadcast(often.distinct().groupBy("sign").agg(*whole(lambda c: c))), "sign").select("node", "lo", "hi", "all")
        held = rest.unionByName(often)
        buckets = s.write(held.filter("lo != hi").select(F.xxhash64("lo", "hi", "all").alias("bucket"), "node").distinct())
        shapes = profiles.filter("bits IS NOT NULL").select(F.col("d1").alias("node"), F.col("n_shingles").alias("n"), "bits").dropDuplicates(["node"])
        filled = _parted(s, buckets.join(shapes, "node"), "bucket", "node", BUCKET_TOKENS)
        edges = s.write(_solve(_tasks(filled, "bucket", ["node", "part", "n", "bits"]), 3, "bigint", _may_link(num, den)).distinct())
        blocks = connected(s, edges)

        # sets of blocks with another set in them, by their representative document
        members = s.write(sets.join(blocks.select(F.col("node").alias("d1"), F.col("root").alias("block")), "d1").select("block", "rep", "n"))
        placed = _parted(s, members, "block", "rep", BLOCK_TOKENS)
        texts = rows.join(placed.select(F.col("rep").alias("id"), "block", "parts", "part"), "id")

        def of_batch(batch: pa.RecordBatch) -> dict:
            tokens = [shingles(words, n).tobytes() for _, words in hashed_texts([(t or b"").lower() for t in utf8(batch.column(4))])]
            return {k: batch.column(i) for i, k in enumerate(("id", "block", "parts", "part"))} | {"tokens": tokens}

        held = map_batches(texts.select("id", "block", "parts", "part", "text"), of_batch, f"id {kind}, block bigint, parts int, part int, tokens binary")
        # a repeated id brings equal tokens, which changes nothing
        links = s.write(_solve(_tasks(held, "block", ["id", "part", "tokens"]), 3, kind, _do_link(num, den)))
        roots = connected(s, links)

        found = sets.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("d1", "d2", "rep", F.coalesce("root", "rep").alias("component_id"))
        found = s.write(found)
        out = profiles.select("id", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
        return s.keep(out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("rep", "id").alias("rep")))
