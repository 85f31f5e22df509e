"""Media columns: interleaved document sequences.

``interleave`` parses HTML into an ordered array of parts. A text part holds its text; a media part holds the digest
its ``src`` names (``sha256:<hex>``), its caption and, after a join on the digest, the stored media's columns. Order
and captions come from the page alone, so a reference that no media row answers keeps its place with null media. Only
media parts are joined. Digests with more than one reference of ``HOT`` are at most ``HOT`` and so may be broadcast; their
references are dealt over several keys, and their media rows repeated for each, so a picture that is everywhere is no
task of its own.

``store_payloads`` keeps a text's bytes as 8-bit grey samples of a PNG (576 a row), ``read_payloads`` reads the stored
bytes back and computes features from the samples it finds there.

``page_of`` makes a document a page: its first line, the picture with a caption, the rest.

Null text or HTML is empty. An empty text's payload is one row of padding. Equal texts have equal digests and share
one media row, made before the join, so copies don't multiply. Extra columns are kept apart by the names
``id``/``html``/``digest`` given as parameters. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.arrow import map_batches, utf8
from larkspur.llm.scratch import Scratch

ROW, PAD = 576, b"\xff"
MARK = b"\x89PNG\r\n\x1a\n"
#: A digest is hot if more than one of so many references is to it.
HOT = 1000


def payload_of(text: bytes) -> bytes:
    """The text padded with bytes 255 to a positive multiple of ROW."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey PNG of ROW columns whose samples are the payload."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(lines), ROW + 1), np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return MARK + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """Rows of samples of a PNG that ``to_png`` wrote; every chunk's checksum is checked."""
    if stored[:8] != MARK:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows aren't written here")
    return raw[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit hash of which parts of the samples lie above their mean."""
    flat = samples.ravel()
    cells = np.add.reduceat(flat, np.arange(64) * len(flat) // 64, dtype=np.int64) / np.diff(np.arange(65) * len(flat) // 64)
    bits = int("".join("1" if c else "0" for c in cells > cells.mean()), 2)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={flat.mean():.4f};std={flat.std():.4f};ahash={bits:016x}"


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, n_bytes, digest of the stored form, the stored form itself (media), and the columns ``keep``."""
    kinds = {f"c{k}": df.schema[c].dataType.simpleString() for k, c in enumerate((id_col, *keep))}

    def of_batch(batch: pa.RecordBatch) -> dict:
        texts = [x or b"" for x in utf8(batch.column(0))]
        media = [to_png(payload_of(x)) for x in texts]
        made = {"n_bytes": [len(x) for x in texts], "digest": [hashlib.sha256(m).hexdigest() for m in media], "media": media}
        return made | {name: batch.column(k + 1) for k, name in enumerate(kinds)}

    rows = df.select(F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(name) for name, c in zip(kinds, (id_col, *keep), strict=True)])
    made = map_batches(rows, of_batch, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", n_bytes bigint, digest string, media binary", rows=500)
    first, *others = (F.col(name).alias(c) for name, c in zip(kinds, (id_col, *keep), strict=True))
    return made.select(first, "n_bytes", "digest", "media", *others)


def read_payloads(stored: DataFrame) -> DataFrame:
    """One row for each different ``digest``: what the stored bytes hold when they are read back."""

    def of_batch(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        seen: set[str] = set()
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest in seen:
                continue
            seen.add(digest)
            samples = from_png(media)
            payload = samples.tobytes()
            row = (digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    ddl = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    read = map_batches(stored.select("digest", "media"), of_batch, ddl)
    return read.groupBy("digest").agg(*[F.min(c).alias(c) for c in read.columns[1:]])


class _Parts(HTMLParser):
    """Text and media references in page order; a figure's caption goes to its media."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.parts.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("img", "audio", "video", "source"):
            src = named.get("src") or ""
            if src.startswith("sha256:"):
                self.flush()
                self.parts.append({"kind": "media", "text": None, "digest": src[7:].lower(), "caption": named.get("alt") or None})
        elif tag == "figure":
            self.flush()
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "section", "article", "tr", "blockquote"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for part in self.parts[self.figure if self.figure is not None else len(self.parts) :]:
                if part["kind"] == "media":
                    part["caption"] = text
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "section", "article", "tr", "blockquote"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse_parts(html: str) -> list[dict]:
    parser = _Parts()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.parts


PART = "struct<position:int,kind:string,text:string,digest:string,caption:string>"


def page_parts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each text or media part of each page, with its position (from 0) and the page's columns ``keep``."""
    kinds = {f"c{k}": pages.schema[c].dataType.simpleString() for k, c in enumerate((id_col, *keep))}

    def of_batch(batch: pa.RecordBatch) -> dict:
        found = [[{"position": i, **p} for i, p in enumerate(parse_parts((x or b"").decode("utf-8", "replace")))] for x in utf8(batch.column(0))]
        return {"parts": found} | {name: batch.column(k + 1) for k, name in enumerate(kinds)}

    rows = pages.select(F.col(html_col).cast("string").alias("html"), *[F.col(c).alias(name) for name, c in zip(kinds, (id_col, *keep), strict=True)])
    made = map_batches(rows, of_batch, ", ".join(f"{n} {t}" for n, t in kinds.items()) + f", parts array<{PART}>")
    return made.select(*[F.col(name).alias(c) for name, c in zip(kinds, (id_col, *keep), strict=True)], F.inline("parts"))


def interleave(pages: DataFrame, media: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The parts of ``page_parts`` with the columns of ``media`` (one row for each ``digest``) as struct ``media``."""
    with Scratch(pages.sparkSession) as s:
        parts = s.keep(page_parts(pages, id_col, html_col, keep))
    named = parts.filter("kind = 'media'")
    counts = named.groupBy("digest").count()
    many = (named.count() // HOT) + 1
    hot = counts.filter(F.col("count") > many).select(F.col("digest").alias("hot"), F.ceil(F.col("count") / many).cast("int").alias("keys"))  # fewer than HOT rows
    row = F.struct([F.col(c) for c in media.columns if c != "digest"]).alias("media")
    held = media.join(F.broadcast(hot), media["digest"] == hot["hot"], "left")
    held = held.select(F.col("digest").alias("media_digest"), F.explode(F.sequence(F.lit(0), F.coalesce("keys", F.lit(1)) - 1)).alias("media_key"), row)
    dealt = named.join(F.broadcast(hot), named["digest"] == hot["hot"], "left")
    dealt = dealt.withColumn("key", F.pmod(F.xxhash64(id_col, "position"), F.coalesce("keys", F.lit(1))).cast("int"))
    joined = dealt.join(held, (dealt["digest"] == held["media_digest"]) & (dealt["key"] == held["media_key"]), "left").select(*parts.columns, "media")
    return joined.unionByName(parts.filter("kind = 'text'").withColumn("media", F.lit(None).cast(joined.schema["media"].dataType)))


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """HTML of a document: its first line, the picture with its caption, and the rest of the text."""
    marked = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    first = F.substring_index(marked, "\n", 1)
    rest = F.substring(marked, F.length(first) + 2, F.length(marked))
    return F.concat(F.lit("<p>"), first, F.lit('</p><figure><img src="sha256:'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure><p>"), rest, F.lit("</p>"))
