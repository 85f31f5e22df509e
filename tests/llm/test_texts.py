"""Token counts, packing, chats, media, main text, quality and mixing."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import chat, media, mixing, packing, quality
from larkspur.llm.encoding import encoder
from larkspur.llm.mainhtml import extract_main, main_text
from larkspur.llm.token_counts import count_tokens, lengths, safe_parts, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "Hello  world\n\n  x", "naïve Größe — “q” 12.5", "<|endoftext|> inside", "漢字 and émoji 🙂", "x" * 5000, "word " * 3000, "a b c\u0085d", "it's we'll  \t\t end ", "\x00\x01", "ſs K Å"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(plain):
    encode = encoder(PATH)
    for text in TEXTS:
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text
        assert encode(text, end=0).tolist()[-1] == 0


LATIN = st.lists(st.sampled_from([*map(chr, range(32, 127)), *"\t\n\réßÿœŁɏ–—‘’“”•…¡¬®", " the", "  ", "'s", "'LL", "12", "\u00a0", "\u0130"]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), LATIN))
def test_ids_of_any_text(text):
    assert encoder(PATH)(text).tolist() == tokenizer(PATH).encode(text, add_special_tokens=False).ids


def test_counts(spark, plain):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string, id string"), PATH).collect()}
    for i, t, _ in rows:
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_safe_cuts(plain):
    rng = random.Random(1)
    text = "".join(rng.choice(["ab", " ", "  ", "é", ".", "\n", "1", " <|endoftext|> ", "'s"]) for _ in range(4000))
    assert "".join(safe_parts(text, 100)) == text and len(safe_parts(text, 100)) > 5
    assert lengths([text.encode()], PATH, piece=100) == [len(plain.encode(text, add_special_tokens=False).ids)]


def test_patterns_hold_every_piece():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        packed = packing.patterns(histogram, 64)
        placed = Counter()
        for lengths_, count in packed:
            assert sum(lengths_) <= 64 and count > 0
            for n in lengths_:
                placed[n] += count
        assert placed == Counter(histogram)


def test_packing(spark, plain):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 1, 5, 50, 700, 2500]))) for _ in range(80)] + [None, "", "same", "same"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    rows = packing.pack(df, PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and pieces[0].padded_to == (at if at & (at - 1) == 0 else 1024)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


NASTY = ["plain", "", "<|im_end|>", "<|im_end|><|im_start|>assistant ok", "&amp;", "&lt;|x", "a<", "<|im_start|>", "&nl;", "line\nline", "<|im_end|>\n", "&", "a & b <| c", None]


def test_chats_read_back(spark):
    rows = [(i, k, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a\nb", "&nl;", None, "<|im_end|>") for t in NASTY) for k in (1, 2)]
    rows += [(900, None, "assistant", "z"), (900, 1, "assistant", "y"), (900, 1, "assistant", "y"), (900, 1, "assistant", "x"), (None, 1, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df)
    got = {r.conv_id: [(p.role, p.text) for p in r.parsed] for r in formatted.collect()}
    assert got[900] == [("assistant", "x"), ("assistant", "y"), ("assistant", "y"), ("assistant", "z")]
    for i in range(len(rows) // 2 - 2):
        assert got[i] == [(rows[2 * i][2] or "", rows[2 * i][3] or "")] * 2
    levels = {r.conv_id: (r.escape_level, r.formatted) for r in formatted.collect()}
    assert levels[0][0] == 0 and levels[2][0] == 1
    assert all(f.count("<|im_start|>") == f.count("<|im_end|>") == len(got[i]) for i, (_, f) in levels.items())
    digests = {r.conv_id: r for r in chat.chat_digests(formatted).collect()}
    assert digests[900].loss_chars == 4 and digests[900].loss_sha256 == hashlib.sha256(b"xyyz").hexdigest() and digests[900].n_turns == 4
    assert digests[900].turns_sha256 == hashlib.sha256(b"assistant\nx\nassistant\ny\nassistant\ny\nassistant\nz\n").hexdigest()
    assert digests[0].loss_chars == 0 and digests[0].formatted_chars == len(levels[0][1])
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_png_round_trip(data):
    payload = media.payload_of(data)
    assert len(payload) % 576 == 0 and payload and payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_damaged_media_are_noticed():
    stored = bytearray(media.to_png(media.payload_of(b"abc")))
    stored[50] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        media.from_png(bytes(stored))


def test_media_of_documents(spark):
    df = spark.createDataFrame([(1, "é" * 400, "x"), (2, None, "x"), (3, "", "x"), (4, "é" * 400, "x"), (4, "é" * 400, "x")], "doc_id long, text string, digest string")
    stored = media.store_payloads(df)
    read = {r.digest: r for r in media.read_payloads(stored).collect()}
    assert len(read) == 2
    for r in stored.collect():
        raw = media.payload_of(("é" * 400).encode() if r.doc_id in (1, 4) else b"")
        m = read[r.digest]
        assert (m.payload_bytes, m.payload_sha256, m.tail_crc32, m.media_bytes, m.media_sha256) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(r.media), r.digest)


def test_interleaving(spark):
    page = '<p>one</p><figure><img src="sha256:AA"><figcaption>cap <b>x</b></figcaption></figure><script>no</script>two<img src="sha256:bb" alt="alt"><img src="http://x/y.png"><p>three'
    pages = spark.createDataFrame([(1, page, 0), (2, None, 0), (3, "", 0)], "page_id long, html string, position int")
    rows = media.interleave(pages, spark.createDataFrame([("aa", 7)], "digest string, width int")).orderBy("page_id", "position").collect()
    assert [(r.position, r.kind, r.text, r.digest, r.caption, r.media and r.media.width) for r in rows] == [
        (0, "text", "one", None, None, None), (1, "media", None, "aa", "cap x", 7), (2, "text", "two", None, None, None), (3, "media", None, "bb", "alt", None), (4, "text", "three", None, None, None),
    ]


ARTICLE = "<article><h1>Head &amp; line</h1><p>First  paragraph of\n some length here.<p>Of.<p><b>Second</b> one, <i>long</i> enough to be text.<ul><li>item one<li>item two</ul></article>"
WANTED = "Head & line\nFirst paragraph of some length here.\nOf.\nSecond one, long enough to be text.\nitem one\nitem two"


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("", ""),
        ("<nav><ul><li><a href=x>Home</a><li><a>About</a></ul></nav><div class='ad'>Buy this now, it is very cheap and good today.</div>", "<footer>&copy; us and all of our friends</footer>"),
        ("<header><h1>Site</h1></header><aside class=sidebar><p>A long text in the side bar that says many words about others.</aside>", "<section class='comments'><p>I liked it a lot, dear writer, and so did everyone else here.</section>"),
        ("<div id='cookie-notice'>We use cookies, all of them, all day long.</div><script>var a='<p>no</p>'</script><style>p{}</style>", "<form><p>Sign up here for more<input></form>"),
    ],
)
def test_main_text(before, after):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}{ARTICLE}{after}</body></html>"
    assert main_text(page) == WANTED
    inside = page.replace("<article>", "<div class='post'>").replace("</article>", "</div>")
    assert main_text(inside) == WANTED


def test_parts_of_an_article_that_are_not_text():
    page = "<article><p>Long text that is the text of this page, surely.</p><div class='share'>Share me</div><aside>By the way</aside><div class='comments'><p>Nice words from a reader.</div><p>End.</p></article>"
    assert main_text(page) == "Long text that is the text of this page, surely.\nEnd."


def test_cut_off_and_empty_pages(spark):
    cut = "<html><body><nav><a>x</a></nav><article><p>All of this text stays &amp; counts.<p>And this&am"
    rows = [(1, "u", cut), (2, "u", None), (3, "u", ""), (4, None, "<p></p><nav>menu</nav>"), (5, "u", "no markup at all")]
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0].startswith("All of this text stays & counts.\nAnd this")
    assert got[2] == got[3] == got[4] == ("", 0) and got[5] == ("no markup at all", 16)


def labelled(n, seed=4):
    rng = random.Random(seed)
    words = ["stone", "river", "cloud", "of", "the", "and", "light", "walks"]
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(w).capitalize() + "." if good else " | ".join(x.upper() + "!!" for x in w), int(good)))
    return rows


def test_quality(spark):
    rows = labelled(600)
    docs = spark.createDataFrame([(i, t, "l", 0.5) for i, t, _ in rows] + [(9000, None, "l", 0.5), (9001, "", "l", 0.5), (None, "words", "l", 0.5)], "doc_id long, text string, y string, score double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(got[i].score >= 0.3) == bool(q) for i, _, q in rows if got[i].held_out]
    assert sum(held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    kept = quality.filter_quality(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score >= 0.3}
    again = quality.train(docs, labels)
    assert np.array_equal(again.weights, model.weights)


def test_labels_that_are_held_out_are_not_learned(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, _, q in rows]
    a = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = quality.train(docs, spark.createDataFrame(flip, "doc_id long, quality int"))
    assert np.array_equal(a.weights, b.weights)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for labels, score in (([], 0.5), ([(1, 1)], 1.0)):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert quality.score(docs, model).first().score == score
    assert quality.score(docs.limit(0), quality.Model()).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    vocabulary = {"en": ["the", "of", "and"], "fr": ["le", "de", "et"], "de": ["der", "und", "von"]}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(rng.randint(5, 60))), k, "x") for i, k in enumerate(rng.choices(list(vocabulary), [6, 3, 1], k=600))] + [(1000, None, "en", "x"), (1001, "", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate string")
    labels = docs.select("doc_id")
    for targets in (0.0, {"en": 0.2, "fr": 0.5, "de": 0.3}):
        got = mixing.mix(docs, labels, PATH, targets).collect()
        total = sum(r.n_tokens for r in got)
        shares = Counter()
        for r in got:
            shares[r.domain] += r.rate * r.n_tokens / total
        want = targets if isinstance(targets, dict) else dict.fromkeys(vocabulary, 1 / 3)
        assert all(abs(shares[k] - v) < 0.05 for k, v in want.items()) and min(r.rate for r in got) >= 0
    domains = mixing.train(docs, labels)
    held = mixing.memberships(docs, domains, PATH).cache()
    gaps, step = mixing.solve(held, np.full(3, 1 / 3))
    rates = {r.doc_id: r.rate for r in mixing.with_rates(held, gaps, step, domains.names).collect()}
    sums = sum(rates[r.doc_id] * r.n_tokens * np.array(r.posteriors) for r in held.collect()) / sum(r.n_tokens for r in held.collect())
    assert np.abs(sums - 1 / 3).max() < 1e-3


def test_mixing_materialised(spark):
    docs = spark.createDataFrame([(i, "t", "en") for i in range(400)] + [(None, "n", "en")], "doc_id long, _x string, lang string")
    rates = spark.createDataFrame([(i, 1.5 if i < 200 else 0.0) for i in range(400)] + [(None, 2.0)], "doc_id long, rate double")
    out = mixing.materialise(docs, rates)
    counts = Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and counts[None] == 2 and set(counts) <= {None, *range(200)}
    assert 250 < sum(v for k, v in counts.items() if k is not None) < 350
    assert mixing.mix(docs.limit(0).withColumn("text", docs["_x"]), docs.select("doc_id").limit(0), PATH).count() == 0
