import hashlib
import re
import zlib
from html.parser import HTMLParser

from pairlens.llm import media


def test_items_stay_in_order_with_their_captions():
    html = '<p>one &amp; two</p><figure><img src="sha256:AB" alt="x"><figcaption>cap <b>A</b></figcaption></figure>mid<img src="sha256:cd" alt="alt text"><figure><figcaption>before</figcaption><img src="sha256:ef"></figure><p>end<img src="http://x/y.png"></p>'
    assert media.interleaved(html) == [
        (0, "text", "one & two", None, None, None),
        (1, "media", None, "ab", "cap A", "sha256:AB"),
        (2, "text", "mid", None, None, None),
        (3, "media", None, "cd", "alt text", "sha256:cd"),
        (4, "media", None, "ef", "before", "sha256:ef"),
        (5, "text", "end", None, None, None),
        (6, "media", None, None, None, "http://x/y.png"),
    ]
    assert media.interleaved(None) == media.interleaved("") == []


class Sequence(HTMLParser):
    """Text blocks and media of a page, written apart from the operator, on the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.parts, self.skipped = [], [], []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.items.append(("text", text))

    def handle_starttag(self, tag, attrs):
        if self.skipped or tag in SKIPPED:
            if tag in SKIPPED:
                self.skipped.append(tag)
        elif tag in ("img", "video", "audio", "source", "embed"):
            if dict(attrs).get("src"):
                self.flush()
                self.items.append(("media", dict(attrs)["src"]))
        elif tag == "br":
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skipped:
            self.parts.append(data)


SKIPPED = "script style noscript template iframe svg canvas object textarea select title".split()
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())


def test_sequences_of_pages_equal_brute_force(spark, sf):
    """All pages, with media references put in at the ends of paragraphs, some resolvable and some not."""
    payload = "a picture".encode().ljust(64, b"\0")
    digest = hashlib.sha256(payload).hexdigest()
    pages = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        refs = iter([f'<img src="https://x.example/{r.page_id}.png" alt="a">', f'<img src="sha256:{digest}" alt="b">', "<svg/>", '<video src="v.mp4"></video>'] * 50)
        pages.append((r.page_id, re.sub("</p>", lambda m: next(refs, "") + "</p>", r.html)))
    df = spark.createDataFrame(pages, "page_id long, html string")
    stored = media.read_media(spark.createDataFrame([(media.store(payload),)], "media binary"), keep=("media",))
    table = media.media_table(stored)
    got = {}
    for r in media.resolve(media.parse(df, keep=("page_id",)), table, keep=("page_id",)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got) == len(pages)
    for i, html in pages:
        parser = Sequence()
        parser.feed(html)
        parser.close()
        parser.flush()
        rows = sorted(got[i], key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        assert [(r.kind, r.text if r.kind == "text" else r.src) for r in rows] == parser.items
        for r in rows:
            resolved = r.src == f"sha256:{digest}"
            assert (r.media is not None) == resolved and (not resolved or media.load(bytes(r.media))[2] == payload and r.caption == "b")


def test_long_texts(spark):
    text = "long & <text> é " * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = media.read_media(media.store_texts(df), keep=("n_bytes",)).collect()[0]
    raw = text.encode()
    assert (row.n_bytes, row.digest) == (len(raw), hashlib.sha256(raw.ljust(-(-len(raw) // 64) * 64, b"\0")).hexdigest())
    html = "<p>" + "word " * 500_000 + '<img src="x.png"></p>'
    assert [x[1] for x in media.interleaved(html)] == ["text", "media"] and len(media.interleaved(html)[0][2]) == 5 * 500_000 - 1


def test_query(spark, sf):
    rows = media.op7_media(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.store(payload)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.load(stored)[2] == payload and r.caption == d.source


def test_nulls_repeats_and_missing_payloads(spark):
    df = spark.createDataFrame([(1, None, b"q"), (2, "", b"q"), (3, "é" * 32, None), (3, "é" * 32, None), (None, "\x00a", b"")], "doc_id long, text string, media binary")
    stored = media.read_media(media.store_texts(df), keep=("n_bytes",))
    assert sorted((r.n_bytes, r.payload_bytes) for r in stored.collect()) == [(0, 64), (0, 64), (2, 64), (64, 64), (64, 64)]
    parsed = spark.createDataFrame([(1, '<img src="sha256:nowhere">t'), (2, None)], "doc_id long, html string")
    out = media.resolve(media.parse(parsed, keep=("doc_id",)), media.media_table(stored), keep=("doc_id",)).collect()
    assert sorted((r.position, r.kind, r.payload_bytes) for r in out) == [(0, "media", None), (1, "text", None)]
    assert media.media_table(media.read_media(media.store_texts(df.limit(0)), keep=("n_bytes",))).count() == 0


def test_whole_texts_are_stored_and_interleaved(spark, tmp_path, monkeypatch):
    kept, staged = {}, media.staged
    monkeypatch.setattr(media, "staged", lambda df, name: kept.setdefault(name, staged(df, name)))
    long = "A line & <b>more</b>\n\n" * 200 + "the end"
    texts = ["ab", "ab\x00", "ab\x00\x00", long, "\n late", None]
    spark.createDataFrame([(i, t, "s<1>") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.op7_media(spark, str(tmp_path)).collect()}
    assert [got[i].n_bytes for i in range(6)] == [len((t or "").encode()) for t in texts]
    assert [got[i].position for i in range(6)] == [1, 1, 1, 1, 1, 0] and got[0].payload_sha256 == got[2].payload_sha256
    assert sorted(media.load(bytes(r.media))[2] for r in kept["stored"].collect()) == sorted((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0") for t in texts)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    items = {r.doc_id: media.interleaved(r.html) for r in docs.select("doc_id", media.document_html(docs.text, docs.source).alias("html")).collect()}
    assert items[3][0][2] == " ".join(long.split()) and [x[1] for x in items[3]] == ["text", "media"] and items[3][1][4] == "s<1>"


def test_references_of_pages_that_load_late():
    src = lambda html: [x[5] for x in media.interleaved(html) if x[1] == "media"]
    assert src('<picture><source srcset="a.webp 1x, b.webp 2x"><source srcset="c.avif"><img data-src="d.jpg" srcset="e.jpg 100w, f.jpg 900w, g.jpg 50w" alt="x"></picture>') == ["d.jpg"]
    assert src('<picture><source srcset="a.webp 1x, b.webp 2x"><img alt="x"></picture>') == ["b.webp"]
    assert src('<picture><source srcset="a.webp"></picture><img srcset="e.jpg 100w, f,1.jpg 900w,g.jpg 50w">') == ["a.webp", "f,1.jpg"]
    assert src('<img src="data:image/gif;base64,R0==" data-src=" real.png "><img src="data:image/gif;base64,R0=="><img>') == ["real.png", "data:image/gif;base64,R0=="]
    assert src('<img srcset="data:image/png;base64,AAA= 1x, sha256:AB 3x"><img data-srcset="a.png, b.png 2x">') == ["sha256:AB", "b.png"]
    assert src('<video poster="p.jpg"><source src="v.webm"><source src="v.mp4"></video><video src="w.mp4"></video><audio src="a.ogg"><embed src="e.pdf">') == ["p.jpg", "v.webm", "v.mp4", "w.mp4", "a.ogg", "e.pdf"]
    assert src('<figure><picture><source srcset="a.webp"><img src="b.jpg"></picture><figcaption>both</figcaption></figure>') == ["b.jpg"]
    assert media.interleaved('<figure><picture><source srcset="a.webp"></picture><figcaption>both</figcaption></figure>')[0][4] == "both"
    assert media.largest("") == media.largest(" , ,") == "" and media.largest("a 1w bad, b 0.5x, c") == "a"


def test_feature_by_definition():
    import math
    import random

    r = random.Random(1)
    for raw in (bytes(64), bytes(range(256)), bytes([7]) * 640, bytes(r.choice(b"ab \xff") for _ in range(64 * 9))):
        n = len(raw)
        mean = sum(raw) / n
        deviation = math.sqrt(sum((x - mean) ** 2 for x in raw) / n)
        shares = [raw.count(bytes([v])) / n for v in set(raw)]
        entropy = abs(sum(p * math.log2(p) for p in shares))
        assert media.feature(64, n // 64, raw) == f"64x{n // 64} mean={mean:.4f} dev={deviation:.4f} entropy={entropy:.4f}"
