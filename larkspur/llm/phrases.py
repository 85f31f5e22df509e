"""Substring dedup by repeated-phrase automata.

A word is removed when a window of ``SPAN`` words that covers it also starts earlier: in a document with a smaller id,
or earlier in the same document. Windows are judged on the texts as they came.

1. *Find.* Of each window the least hash of its ``ANCHOR``-word pieces is its anchor, so equal windows have equal
   anchors, and a text has one for about seven words. Anchors that stand at two places in texts of different content
   (or twice in one) may hold repeated windows; all other windows can't be repeated. Texts whose words are all equal
   to those of a smaller id need no search: every window of theirs starts earlier.
2. *Confirm.* Around each such anchor the words of its windows form a fragment; neighbouring windows whose anchors are
   equal share one, so a text that repeats a few words has few. Of equal fragments the first, found by an aggregation
   that combines before the shuffle, stands for all; the windows of the others all start earlier. The firsts go to the
   shard of their anchor; there, windows that occur twice by hash are the recurring phrases. Where an anchor has more than
   ``often`` of them, they go window by window instead, and an aggregation by the words themselves finds the first.
3. *Locate.* Each shard compiles its phrases into Aho-Corasick automata, ``batch_rows`` fragments at a time, and streams
   the fragments through them. Words are coded by three letters of three alphabets, so a match is a match of whole
   words, and a hash that lied matches nothing. A phrase's first place, by id and start, keeps its words.
4. *Remove.* Places of later occurrences go back to their documents.

Copies add nothing but a row to steps 2 and 3. A shard holds ``batch_rows`` + ``often`` fragments at a time at most, as no
anchor there has more than ``often``.

Null text has no words. Rows that share an id count as one document if their words are equal, else they are ordered by
a digest. Rows with a null id stay whole and are never earlier than another, as in the query's SQL. Only the id and text columns are read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.llm.arrow import map_arrow, map_batches, schema_of, utf8
from larkspur.llm.hot import hot_keys, split
from larkspur.llm.scratch import Scratch
from larkspur.llm.words import hashed_texts, windows

SPAN, ANCHOR = 20, 6
#: Fragments that one automaton is made for, and the most windows in one (their marks are the bits of a long).
PHRASES, WINDOWS = 8_000, 60
#: Different fragments over which an anchor is frequent.
OFTEN = 1000
#: Texts of which a task remembers that it wrote their anchors; only saves work.
SEEN = 200_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def anchors(words: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pieces, and for each window the number of the piece that is its anchor."""
    pieces = windows(words, ANCHOR)
    reach = span - ANCHOR + 1
    if len(pieces) < reach:
        return pieces, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(pieces, reach)
    return pieces, view.argmin(1) + np.arange(len(view))


def _profiles(rows: DataFrame, span: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, n_words bigint, d1 bigint, d2 bigint, sha string, anchors array<struct<h:bigint,twice:boolean>>"
    spark_schema = schema_of(ddl)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(1))]
            n, d1, d2, sha, h, twice, ends = [], [], [], [], [], [], [0]
            for i, words in hashed_texts(texts):
                digest = xxhash.xxh3_128_intdigest(words.tobytes())
                n.append(len(words))
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & (1 << 64) - 1) - (1 << 63))
                sha.append(hashlib.sha256(b" ".join(texts[i].split())).hexdigest())
                ends.append(ends[-1])
                if len(words) >= span and digest not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    pieces, at = anchors(words, span)
                    values, count = np.unique(pieces[np.unique(at)], return_counts=True)
                    h.append(values.view(np.int64))
                    twice.append(count > 1)
                    ends[-1] += len(values)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(h) if h else [], pa.int64()), pa.array(np.concatenate(twice) if twice else [], pa.bool_())], ["h", "twice"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sha), lists.cast(arrow_schema.field("anchors").type)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return map_arrow(rows, run, spark_schema)


def _fragments(texts: DataFrame, span: int) -> DataFrame:
    """id, d1, text and, for each anchor of ``found``, where its windows begin, how many there are, and their words."""
    kind = texts.schema["id"].dataType.simpleString()

    def of_batch(batch: pa.RecordBatch) -> dict:
        found, out, same = batch.column(2).to_pylist(), [], []
        raw, digests = [t or b"" for t in utf8(batch.column(3))], batch.column(1).to_pylist()
        for i, hashes in hashed_texts(raw):
            if (xxhash.xxh3_128_intdigest(hashes.tobytes()) >> 64) - (1 << 63) != digests[i]:
                continue  # another text of the same id
            same.append(i)
            pieces, at = anchors(hashes, span)
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            keys = pieces[at[cut]].view(np.int64)
            good = np.flatnonzero(np.isin(keys, np.array(found[i], np.int64)))
            words, stop, spans = raw[i].split(), np.append(cut[1:], len(at)), []
            for key, begin, end in zip(keys[good].tolist(), cut[good].tolist(), stop[good].tolist(), strict=True):
                if spans and spans[-1][0] == key and spans[-1][2] == begin and end - spans[-1][1] <= WINDOWS:
                    spans[-1][2] = end
                else:
                    spans.append([key, begin, end])
            pieces_of = [(key, begin, end - begin, b" ".join(words[begin : end + span - 1])) for key, begin, end in spans]
            out.append([{"h": key, "same": xxhash.xxh3_64_intdigest(text) - (1 << 63), "start": begin, "n": n, "words": text.decode("utf-8", "replace")} for key, begin, n, text in pieces_of])
        at = pa.array(same, pa.int64())
        return {"id": batch.column(0).take(at), "d1": batch.column(1).take(at), "text": batch.column(3).take(at), "found": out}

    return map_batches(texts.select("id", "d1", "found", "text"), of_batch, f"id {kind}, d1 bigint, text string, found array<struct<h:bigint,same:bigint,start:int,n:int,words:string>>")


class Coder:
    """Words as three letters, one of each of three alphabets, so that letters never match across words."""

    SIDE = 128

    def __init__(self):
        self.known: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        k = len(self.known)
        a, b, c = k // self.SIDE**2, k // self.SIDE % self.SIDE, k % self.SIDE
        code = chr(0x4E00 + c) + chr(0x4E00 + self.SIDE + b) + chr(0x4E00 + 2 * self.SIDE + a)
        self.known[word] = code
        return code

    def code(self, words: list[str]) -> str:
        known = self.known
        return "".join([known.get(w) or self.__missing__(w) for w in words])


def repeated(batch: list[tuple], span: int) -> list[tuple]:
    """(id, d1, start, bits) of fragments with windows that started earlier: bit j stands for window start + j.

    ``batch``: (anchor, id, d1, start, n, words), ordered.
    """
    coder = Coder()
    coded = [coder.code(x[5].split(" ")) for x in batch]
    size = 3 * span
    # confirm by hash: windows are counted within the batch
    hashes: list[int] = []
    for x, text in zip(batch, coded, strict=True):
        hashes += [hash(text[3 * j : 3 * j + size]) for j in range(x[4])]
    values, inverse, count = np.unique(np.array(hashes, np.int64), return_inverse=True, return_counts=True)
    recurring = (count > 1)[inverse]
    automaton, at, numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0, 0
    for x, text in zip(batch, coded, strict=True):
        for j in np.flatnonzero(recurring[at : at + x[4]]):
            phrase = text[3 * j : 3 * j + size]
            if phrase not in automaton:
                automaton.add_word(phrase, numbers)
                numbers += 1
        at += x[4]
    out = []
    if not numbers:
        return out
    automaton.make_automaton()
    owned: set[int] = set()
    for x, text in zip(batch, coded, strict=True):
        bits = 0
        for end, phrase in automaton.iter(text):
            if phrase in owned:
                bits |= 1 << (end + 1 - size) // 3
            else:
                owned.add(phrase)
        if bits:
            out.append((x[1], x[2], x[3], bits))
    return out


def _locate(fragments: DataFrame, span: int, batch_rows: int) -> DataFrame:
    kind = fragments.schema["id"].dataType.simpleString()
    spark_schema = schema_of(f"id {kind}, d1 bigint, start int, bits bigint")
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*repeated(rows, span), strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:4] == held[-1][:4]:  # the same document once more
                    continue
                if len(held) >= batch_rows and row[0] != held[-1][0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return map_arrow(fragments, run, spark_schema)


def _removed(texts: DataFrame, span: int, with_text: bool) -> DataFrame:
    """Each text without the words under its marks."""
    kind = texts.schema["id"].dataType.simpleString()

    def of_batch(batch: pa.RecordBatch) -> dict:
        removed, sha, kept = [], [], []
        for marks, raw in zip(batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
            spans = [m.span() for m in WORD.finditer(raw)]
            edge = np.zeros(len(spans) + 1, np.int64)
            for m in marks:
                for j in range(m["bits"].bit_length()):
                    if m["bits"] >> j & 1:
                        edge[m["start"] + j] += 1
                        edge[m["start"] + j + span] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            left = np.flatnonzero(~gone)
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(raw[slice(*spans[i])] for i in left)).hexdigest())
            if with_text:  # runs of kept words as they stood, one line break where words went
                runs = np.split(left, np.flatnonzero(np.diff(left) > 1) + 1) if len(left) else []
                kept.append(b"\n".join(raw[spans[r[0]][0] : spans[r[-1]][1]] for r in runs).decode("utf-8", "replace"))
        return {"id": batch.column(0), "d1": batch.column(1), "n_removed": removed, "sha": sha, "kept": kept if with_text else [None] * len(sha)}

    return map_batches(texts.select("id", "d1", "marks", "text"), of_batch, f"id {kind}, d1 bigint, n_removed bigint, sha string, kept string")


def _firsts(s: Scratch, fragments: DataFrame, same: str) -> tuple[DataFrame, DataFrame]:
    """(the first fragment of each text, marks of all windows of the others); ``same`` tells texts of one ``h`` apart."""
    place = F.struct(*[c for c in ("id", "d1", "start", "n", "words") if c != same])
    firsts = s.write(fragments.groupBy("h", same).agg(F.min(place).alias("f")).select("h", same, "f.*"))
    held = firsts.select("h", same, F.struct("id", "d1", "start").alias("f"))
    others = fragments.select("h", same, "id", "d1", "start", "n").join(held, ["h", same]).filter(~F.struct("id", "d1", "start").eqNullSafe(F.col("f")))
    return firsts, others.select("id", "d1", "start", F.expr("shiftleft(1L, n) - 1 AS bits"))


def _windows_apart(fragments: DataFrame, span: int) -> DataFrame:
    """A fragment for each window, with a hash of its own words in place of the anchor."""
    words = F.split("words", " ")
    of = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("start") + i).alias("start"), F.array_join(F.slice(words, i + 1, F.lit(span)), " ").alias("words")))
    return fragments.select("id", "d1", F.inline(of)).select("id", "d1", F.xxhash64("words").alias("h"), "start", F.lit(1).alias("n"), "words")


def repeated_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = False, batch_rows: int = PHRASES, often: int = OFTEN) -> DataFrame:
    """``id_col``, n_words, n_removed, kept_sha256 (of the kept words, joined by one space) of each row.

    ``with_text`` adds kept_text: null where nothing was removed.
    """
    if not ANCHOR < span <= ANCHOR + 30:
        raise ValueError(f"span is from {ANCHOR + 1} to {ANCHOR + 30} words")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as s:
        profiles = s.write(_profiles(rows, span))
        firsts = s.write(profiles.groupBy("d1", "d2").agg(F.min("id").alias("first")))

        places = profiles.filter(F.size("anchors") > 0).select("d1", F.inline("anchors"))
        # an anchor that a large part of the texts have is aggregated, which combines before the shuffle; others meet
        hot, rest = split(places, hot_keys(places, "d1", "h"), "h")
        whole = Window.partitionBy("h")
        many = lambda over: (over(F.max("twice")) | (over(F.min("d1")) != over(F.max("d1")))).alias("many")
        rest = rest.select("d1", "h", many(lambda c: c.over(whole))).filter("many")
        hot = hot.join(F.broadcast(hot.groupBy("h").agg(many(lambda c: c))), "h").filter("many").select("d1", "h", "many")
        places = rest.unionByName(hot)
        found = places.groupBy("d1").agg(F.collect_set("h").alias("found"))
        found = s.write(found.join(firsts, "d1").select(F.col("first").alias("id"), "d1", "found"))

        pieces = s.write(_fragments(rows.join(found, "id"), span))
        fragments = pieces.select("id", "d1", F.inline("found"))
        unique, copies_of = _firsts(s, fragments, "same")
        # the windows of a frequent anchor are compared word by word; equal windows have equal anchors, so none is elsewhere
        frequent = s.write(unique.groupBy("h").count().filter(F.col("count") > often).select("h"))
        parted = s.write(_windows_apart(unique.join(frequent, "h", "left_semi"), span))
        _, copies_of_windows = _firsts(s, parted, "words")
        shards = unique.join(frequent, "h", "left_anti")
        located = _locate(shards.select("h", "id", "d1", "start", "n", "words").repartition("h").sortWithinPartitions("h", "id", "d1", "start"), span, batch_rows)
        marks = located.unionByName(copies_of).unionByName(copies_of_windows)
        marks = marks.groupBy("id", "d1").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))
        changed = _removed(pieces.select("id", "d1", "text").join(marks, ["id", "d1"]), span, with_text)
        changed = s.write(changed.dropDuplicates(["id", "d1"]))

        copies = firsts.select("d1", "d2", "first")
        out = profiles.select("id", "n_words", "d1", "d2", "sha").join(copies, ["d1", "d2"]).join(changed.withColumnRenamed("sha", "new_sha"), ["id", "d1"], "left")
        copy = (F.col("id") != F.col("first")) & (F.col("n_words") >= span)
        out = out.select(
            F.col("id").alias(id_col), "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
            F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
            F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept_text"),
        )
        return s.keep(out if with_text else out.drop("kept_text"))
