"""Packing by shortest-pack-first over the length histogram.

A document is its token ids and one id 0 behind them, cut into pieces of at most ``width`` ids. Only the histogram of
piece lengths, at most ``width`` numbers, comes to the driver. There lengths are placed longest first: a length goes on
the open pattern with the fewest ids so far that has room for it, else it opens one, and the counts of both patterns
are updated. A pattern then is a list of lengths with a count of sequences.

Patterns go back to documents by rank: the r-th piece of a length, ordered by salt and id, takes the r-th place that the
patterns have for it. Ranks come from windows over (length, salt): a length of n pieces has
sqrt(n) / ``PER_SALT`` salts, so a hot one is spread over many tasks, and the counts before each salt, which grow with that
root too, are broadcast.

Null text is empty and packs as the id 0 alone. Repeated rows are packed each for itself. Extra columns aren't read.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm.arrow import map_arrow, schema_of, utf8
from larkspur.llm.encoding import encoder
from larkspur.llm.scratch import Scratch

WIDTH, PER_SALT = 1024, 4


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences) of all sequences; lengths are in the order they were placed."""
    open_: dict[int, list[list]] = defaultdict(list)  # ids so far -> [[lengths, count]]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fits = [n for n, held in open_.items() if held and n + length <= width]
            if fits:
                held = open_[min(fits)]
                lengths, count = held.pop()
                # the emptiest first; a length placed now may open room for more of itself
                take = min(left, count)
                if count > take:
                    held.append([lengths, count - take])
            else:
                room = width // length  # a new pattern takes all of this length that fit
                take = left // room if left >= room else 1
                each = min(room, left)
                open_[each * length].append([(length,) * each, take])
                left -= each * take
                continue
            open_[sum(lengths) + length].append([(*lengths, length), take])
            left -= take
    return [(tuple(lengths), count) for held in open_.values() for lengths, count in held]


def places(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset) of each place of each pattern."""
    out, used, sequence = [], defaultdict(int), 0
    for lengths, count in packed:
        offset = 0
        for length in lengths:
            out.append((length, used[length], used[length] + count, sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return out


def _pieces(rows: DataFrame, path: str, width: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    spark_schema = schema_of(f"id {kind}, start bigint, length int, ids_crc32 bigint, doc_tokens bigint")
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                ids = encode((text or b"").decode("utf-8", "replace"), end=0)
                data = memoryview(ids).cast("B")
                for k in range(0, len(ids), width):
                    n = min(width, len(ids) - k)
                    at.append(i)
                    start.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * k : 4 * (k + n)]))
                    total.append(len(ids))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, f.type) for v, f in zip((start, length, crc, total), list(arrow_schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return map_arrow(rows, run, spark_schema)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and padded_to (its sequence's width)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as s:
        pieces = s.write(_pieces(rows, path, width))
        salts = [(r["length"], ceil(sqrt(r["count"]) / PER_SALT)) for r in pieces.groupBy("length").count().collect()]  # at most width rows
        salts = spark.createDataFrame(salts, "length int, salts int")
        pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.col("salts")).cast("int")).drop("salts")
        counts = pieces.groupBy("length", "salt").count().collect()
        histogram: dict[int, int] = defaultdict(int)
        first = []
        for r in sorted(counts, key=lambda r: (r["length"], r["salt"])):
            first.append((r["length"], r["salt"], histogram[r["length"]]))
            histogram[r["length"]] += r["count"]
        packed = patterns(dict(histogram), width)
        ends = np.cumsum([0] + [n for _, n in packed])
        full = [(int(ends[k]), int(ends[k + 1]), sum(lengths)) for k, (lengths, _) in enumerate(packed)]
        by_length: dict[int, list] = defaultdict(list)
        base = dict(zip(ends[:-1].tolist(), (x[2] for x in full), strict=True))
        for length, lo, hi, sequence, offset in places(packed):
            by_length[length].append((lo, hi, sequence, offset, base[sequence]))
        table = [(length, [x[0] for x in v], [x[2] - x[0] for x in v], [x[3] for x in v], [x[4] for x in v]) for length, v in by_length.items()]
        slots = spark.createDataFrame(table, "length int, lo array<bigint>, shift array<bigint>, offsets array<int>, fill array<int>")
        begun = spark.createDataFrame(first, "length int, salt int, before bigint")

        rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start"))
        ranked = pieces.withColumn("rank", rank).join(F.broadcast(begun), ["length", "salt"])
        ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before")).join(F.broadcast(slots), "length")
        # the last place of this length that begins at or before the rank
        slot = F.aggregate("lo", F.lit(0), lambda n, lo: n + (lo <= F.col("rank")).cast("int"))
        ranked = ranked.withColumn("slot", slot)
        used = F.element_at("fill", F.col("slot"))
        power = F.bin(used).rlike("^10*$")
        out = ranked.select(
            F.col("id").alias(id_col), "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens",
            (F.col("rank") + F.element_at("shift", F.col("slot"))).alias("sequence_id"),
            F.element_at("offsets", F.col("slot")).cast("bigint").alias("offset"),
            F.when(power, used).otherwise(F.lit(width)).alias("padded_to"),
        )
        return s.keep(out)
