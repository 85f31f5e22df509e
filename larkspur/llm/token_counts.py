"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are encoded in batches balanced by bytes. A text longer than ``piece`` bytes is cut in front of a single
space that stands between a word character and a letter: pre-tokenisation always cuts there, so the counts of
the parts add up to the count of the whole.

Null text counts as empty; an empty text has 0 tokens. Repeated rows are counted each for itself. Only the id
and text columns are read, so other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import by_bytes, map_batches, utf8

#: A single space after a letter and before one.
SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def safe_parts(text: str, piece: int) -> list[str]:
    """Parts of about ``piece`` characters, cut only where a token can't span the cut."""
    parts, start = [], 0
    while len(text) - start > piece:
        cut = SAFE.search(text, start + piece)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


def lengths(texts: list[bytes | None], path: str, piece: int = 1 << 14, batch_bytes: int = 1 << 18) -> list[int]:
    encoder = tokenizer(path)
    owner, parts = [], []
    for i, x in enumerate(texts):
        cut = safe_parts((x or b"").decode("utf-8", "replace"), piece)
        parts += cut
        owner += [i] * len(cut)
    out = [0] * len(texts)
    sized = [p.encode("utf-8", "replace") for p in parts]
    for s in by_bytes(sized, batch_bytes):
        for i, e in zip(owner[s], encoder.encode_batch_fast(parts[s], add_special_tokens=False), strict=True):
            out[i] += len(e)
    return out


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def of_batch(batch: pa.RecordBatch) -> dict:
        texts = utf8(batch.column(1))
        counts = lengths(texts, path)
        return {"id": batch.column(0), "n_bytes": [len(x or b"") for x in texts], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, of_batch, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
