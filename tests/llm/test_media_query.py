"""The query of media columns against the definition, with hot pictures, and interleaving out of the ordinary."""

import hashlib
import zlib

import numpy as np

from larkspur.llm import media, queries


def test_the_query_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "HOT", 8)
    texts = ["", None, "one line", "first & <b>\nsecond\n\nthird &amp; <img src='sha256:00'>", "\n\nleading", "é" * 700 + "\n" + "ü" * 900, "x" * 576, "long " * 200_000]
    rows = [(i, texts[i % len(texts)]) for i in range(40)] + [(100 + i, "hot\ntext") for i in range(200)] + [(7, "again"), (None, "no id")]
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, digest string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_media(spark, str(tmp_path)).collect()
    wanted = []
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        png = media.to_png(payload)
        samples = np.frombuffer(payload, np.uint8)
        wanted.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), f"mean={samples.mean():.4f}", int(bool((text or "").split("\n")[0].strip())), f"document {'' if i is None else i}".strip()))
    mine = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature.split(";")[1], r.position, r.caption) for r in got]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(mine, key=key) == sorted(wanted, key=key)


def test_hot_and_missing_references_keep_their_places(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT", 5)
    page = lambda i: f'a{i}<img src="sha256:aa" alt="{i}">b{i}<img src="sha256:{i:02x}"><p>c{i}'
    pages = spark.createDataFrame([(i, page(i), i * 2) for i in range(60)], "page_id long, html string, size int")
    held = spark.createDataFrame([("aa", 7), ("03", 8), ("unused", 9)], "digest string, width int")
    rows = media.interleave(pages, held, keep=("size",)).collect()
    assert len(rows) == 5 * 60
    for i in range(60):
        own = sorted((r for r in rows if r.page_id == i), key=lambda r: r.position)
        assert [(r.position, r.kind, r.text or r.digest, r.caption, r.media and r.media.width, r.size) for r in own] == [
            (0, "text", f"a{i}", None, None, 2 * i), (1, "media", "aa", str(i), 7, 2 * i), (2, "text", f"b{i}", None, None, 2 * i),
            (3, "media", f"{i:02x}", None, 8 if i == 3 else None, 2 * i), (4, "text", f"c{i}", None, None, 2 * i),
        ]
    assert not media.interleave(pages.limit(0), held).collect()
