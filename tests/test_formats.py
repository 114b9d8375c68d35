import random
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.functions import binary as B, geometry as G, html as H, images as I, raster as R


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.text("ab", max_size=600).map(str.encode), st.integers(0, 900).map(lambda n: b"xyz" * n)))
def test_lz4_round_trip(data):
    assert B.lz4_decompress(B.lz4_compress(data), len(data)) == data


def test_lz4_blocks():
    assert B.lz4_decompress(b"\x30abc", 3) == b"abc"
    assert B.lz4_decompress(b"\x10a\x01\x00\x50bcdef", 10) == b"aaaaabcdef"  # a match over what it makes
    for bad in (b"", b"\x30ab", b"\x10a\x00\x00\x10b", b"\x10a\x05\x00\x10b", b"\x10a\x01\x00", b"\x10a\x01", b"\xf0\xff"):
        with pytest.raises(ValueError):
            B.lz4_decompress(bad, 100)
    with pytest.raises(ValueError):
        B.lz4_decompress(b"\x30abc", 2)


@settings(max_examples=200, deadline=None)
@given(st.text("<p>aé", max_size=80), st.integers(1, 12))
def test_blocks(text, size):
    data = text.encode()
    blocks = list(H.split_blocks(data, size))
    assert b"".join(blocks) == data and all(0 < len(b) <= size for b in blocks)
    at = 0
    for b in blocks[:-1]:
        window = data[at : at + size]
        assert b.endswith(b">") and b">" not in window[len(b) :] if b">" in window[1:] else len(b) == size
        at += len(b)


def test_blobs(spark):
    html = "<p>é</p>" * 50
    assert B.unpack(B.pack(7, "Té", html, 33))[:2] == (7, "Té") and b"".join(B.unpack(B.pack(7, "T", html, 33))[2]).decode() == html
    assert B.unpack(B.pack(1, "x" * 70000, ""))[2] == [] and B.unpack(B.pack_legacy(9, "L", html)) == (9, "L", [html.encode()])
    for bad in (b"", b"WKI2", b"WKI2" + b"\xff" * 8, b"nothing at all", B.pack(7, "T", html)[:-3]):
        assert B.unpack(bad) is None
    df = spark.createDataFrame([(1, "a", html), (2, None, ""), (3, "c", None)], "i long, t string, h string")
    rows = df.select(B.unpacked_articles(B.packed_articles(40)("i", "t", "h")).alias("a")).select("a.*").collect()
    assert [(r["article_id"], r["title"], None if r["blocks"] is None else len(r["blocks"])) for r in rows] == [(1, "a", len(list(H.split_blocks(html.encode(), 40)))), (2, "", 0), (None, None, None)]


def test_binary_columns(spark):
    def one(data, f):
        return spark.createDataFrame([(bytearray(data),)], "d binary").select(f("d").alias("x")).first()["x"]

    assert one(b"\x01\x02\x03\xff", lambda d: B.little_endian(d, 0, 4)) == 0xFF030201 and one(b"\x01", lambda d: B.little_endian(d, 0, 2)) is None
    c = 0
    for b in b"some \xffbytes":
        c = (c * 31 + b) % 2**32
    assert one(b"some \xffbytes", B.rolling_checksum) == c and one(b"", B.rolling_checksum) == 0
    assert [one(x, B.kind_of) for x in (b"WKI2..", b"WIKI", b"qoif", b"\xff\xd8\xff", b"\x89PNG", b"")] == ["article", "legacy", "qoi", "jpeg", "png", "unknown"]
    jpeg = bytes.fromhex("FFD8FFE00004AABBFFDB0003CCFFC0000B08001E00280101") + b"\0" * 8
    assert tuple(one(jpeg, B.picture_size)) == (40, 30) and tuple(one(I.qoi_encode(np.zeros((3, 5, 3), np.uint8)), B.picture_size)) == (5, 3) and one(b"x", B.picture_size) is None


def test_headers_behind_large_segments(spark):
    frame = bytes.fromhex("FFC0000B08001E00280101")
    segment = lambda n: b"\xff\xe1" + (n + 2).to_bytes(2, "big") + b"\xab" * n
    cases = [(b"\xff\xd8" + segment(n) + frame, (40, 30)) for n in (0, 20, 1200, 2000, 65533)]
    cases += [(b"\xff\xd8" + segment(65533) * 4 + frame, (40, 30)), (b"\xff\xd8\xff\xff" + segment(3) + frame, (40, 30)), (b"\xff\xd8" + segment(9), None), (b"\xff\xd8" + frame[:7], None), (b"\xff\xd8\xff\xda\0\x04ab" + frame, None), (b"\xff\xd8\xff\xe1\0\1" + frame, None), (b"\xff\xd8" + b"x" * 50, None), (b"qoif" + b"\xff" * 8, None), (None, None), (b"", None)]
    df = spark.createDataFrame([(k, None if d is None else bytearray(d)) for k, (d, _) in enumerate(cases)], "k int, d binary")
    got = {r["k"]: r["s"] for r in df.select("k", B.picture_size("d").alias("s")).collect()}
    assert [got[k] and tuple(got[k]) for k in range(len(cases))] == [want for _, want in cases]


def filtered(px, kind):
    """A PNG whose rows all have one filter."""
    h, w, lanes = px.shape
    raw = bytearray()
    for y in range(h):
        raw.append(kind)
        for k in range(w * lanes):
            x, c = divmod(k, lanes)
            now, a, b = int(px[y, x, c]), int(px[y, x - 1, c]) if x else 0, int(px[y - 1, x, c]) if y else 0
            d = int(px[y - 1, x - 1, c]) if x and y else 0
            near = min((a, b, d), key=lambda v: abs(a + b - d - v))
            raw.append((now - (0, a, b, (a + b) // 2, near)[kind]) & 255)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[lanes]
    return R.PNG_MAGIC + R._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + R._chunk(b"IDAT", zlib.compress(bytes(raw))) + R._chunk(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(4)
    for lanes in (1, 2, 3, 4):
        px = rng.integers(0, 256, (7, 9, lanes)).astype(np.uint8)
        for kind in range(5):
            got = R.pixels_of(filtered(px, kind))
            assert (got[:, :, :3] == px[:, :, : 3 if lanes > 2 else 1]).all() and (got[:, :, 3] == (px[:, :, -1] if lanes in (2, 4) else 255)).all()
    rgb = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert (R.pixels_of(R.png_encode(rgb))[:, :, :3] == rgb).all()
    head = R.PNG_MAGIC + R._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 2, 2, 3, 0, 0, 0)) + R._chunk(b"PLTE", bytes(range(12))) + R._chunk(b"tRNS", b"\x00\x80")
    small = R.pixels_of(head + R._chunk(b"IDAT", zlib.compress(b"\0\x1b\x40\0\xe4\x80")) + R._chunk(b"IEND", b""))
    assert small[:, :, 0].tolist() == [[0, 3, 6, 9, 3], [9, 6, 3, 0, 6]] and small[0, :2, 3].tolist() == [0, 128]
    for bad in (b"", R.PNG_MAGIC, R.png_encode(rgb)[:-30], b"\xff\xd8\xff"):
        with pytest.raises(ValueError):
            R.pixels_of(bad)


def test_jpeg():
    y, x = np.mgrid[0:61, 0:83]
    smooth = np.stack([128 + 100 * np.sin(x / 9), 128 + 100 * np.cos(y / 7), 128 + 60 * np.sin((x + y) / 11)], 2).astype(np.uint8)
    for quality, most in ((50, 20), (90, 8), (100, 3)):
        got = R.pixels_of(R.jpeg_encode(smooth, quality))
        assert got.shape == (61, 83, 4) and np.abs(got[:, :, :3].astype(int) - smooth).max() <= most
    noise = np.random.default_rng(1).integers(0, 256, (17, 9, 3)).astype(np.uint8)
    assert np.abs(R.pixels_of(R.jpeg_encode(noise, 100))[:, :, :3].astype(int) - noise).max() <= 4
    assert B.size_of(R.jpeg_encode(noise)) == (9, 17)
    data = R.jpeg_encode(noise)
    for bad in (data.replace(b"\xff\xc0", b"\xff\xc2", 1), data[:60], data[: data.index(b"\xff\xda")]):
        with pytest.raises(ValueError):
            R.pixels_of(bad)


def test_pages_of_whole_entries():
    html = b"<p>one</p><p>two</p>" + b"x" * 30 + b">tail"
    known, found, page, more = [0], [], 0, True
    while more:
        a, b, more = H.page_of(html, page, known, 15)
        found.append(html[a:b])
        page += 1
    assert b"".join(found) == html and found[0] == b"<p>one</p><p>" and found[1] == b"two</p>" and all(len(x) <= 15 for x in found)
    assert H.page_of(html, 3, [0], 15) == H.page_of(html, 3, known, 15) and H.page_of(html, 99, [0], 15) == (len(html), len(html), False) and H.page_of(b"", 0, [0]) == (0, 0, False)


def test_qoi_round_trip_and_reduction(spark):
    rng = np.random.default_rng(1)
    for shape, high in (((1, 1), 256), ((7, 9), 256), ((40, 30), 4), ((3, 200), 1)):
        px = rng.integers(0, high, (*shape, 3)).astype(np.uint8)
        px[: shape[0] // 2] = px[0, 0]
        assert (I.qoi_decode(I.qoi_encode(px))[:, :, :3] == px).all()
    flat = np.full((5, 5, 4), 225, np.uint8)
    assert (I.reduced(flat, 2) == 0xFFFF).all() and I.reduced(flat, 2).shape == (3, 2) and I.reduced(flat, 1).shape == (5, 5)
    for bad in (b"", b"qoif" + b"\0" * 30):
        with pytest.raises(ValueError):
            I.qoi_decode(bad)
    df = spark.createDataFrame([(bytearray(I.qoi_encode(flat[:, :, :3])), 2), (bytearray(b"no"), 1), (None, 1)], "d binary, s int")
    assert [(r["w"], r["h"]) for r in df.select(I.decoded("d", "s").alias("x")).select("x.*").collect()] == [(2, 3), (None, None), (None, None)]
    assert I.thumbnail(np.zeros((400, 100, 3), np.uint8), 320, 212).shape == (212, 53, 3) and I.thumbnail(flat, 320, 212) is flat
    assert (I.on_white(np.array([[[0, 0, 0, 0], [9, 9, 9, 255]]], np.uint8)) == [[[255] * 3, [9] * 3]]).all()


def test_image_predicates(spark):
    rows = [("_assets_/x.png", "image/png", 49, 50), ("x.svg", "image/svg+xml; charset=utf-8", 10, 10), ("_mw_/x.png", "image/png", 99, 99), ("a.jpg", "image/webp", 50, 50), ("a", "text/html", 99, 99)]
    df = spark.createDataFrame(rows, "path string, mimetype string, w int, h int")
    got = df.select((I.is_image_entry("path", "mimetype", F.lit(False)) & I.is_large_enough("mimetype", "w", "h")).alias("k"), I.is_diagram("path", "mimetype", F.lit(300)).alias("d")).collect()
    assert [r["k"] for r in got] == [False, True, False, True, False] and [r["d"] for r in got][:4] == [True, True, True, False]


# HTML


def test_cleaning():
    clean = lambda h, t=None, i=None: H.clean(h, t or {}, i)
    page = '<html><body class="x"><nav><a href="k">k</a></nav><table><tr><td>t</table><!-- c --><p id=1>a<sup>2</sup>b<p>c</body></html>'
    assert clean(page) == "<body><p>ab</p><p>c</p></body>"
    assert clean('<p><a href="Knot_theory#H" title=x>k</a> <a href="Unknown">u</a> <a href="http://x">e</a><a>n</a></p>', {"knot theory": 5}) == '<p><a href="/wiki/5">k</a> u <a>e</a><a>n</a></p>'
    figure = '<body><figure><img src="./a.png"><figcaption>cap</figcaption></figure><img src="b"></body>'
    assert clean(figure, None, {"./a.png": (3, 10, 20)}) == '<body><img h="20" src="/img/3" w="10"/></body>' and clean(figure) == "<body></body>"
    spelt = """<A HREF='T1'>1</A><a href=T2>2</a><a x="1>2" href = "T&#51;">3</a><a\nHref='t4#x'>4</a><a href="t5"><a href='no'>n</a>5<script>"<a href='T1'>"</script><!-- <a href=T1> -->"""
    assert re.sub("</?a[^>]*>", "", clean(spelt, {f"t{k}": k for k in range(1, 6)})) == "1234n5"
    assert re.findall(r'href="/wiki/(\d)"', clean(spelt, {f"t{k}": k for k in range(1, 6)})) == list("12345")
    assert H.skeleton("<p>a<img src=x><a href=U>b</a></p>") == (["<p>a", "", "b", "</p>"], [("img", "x"), ("a", "u"), ("/a", "u")])
    assert clean('<body>x<div class="a zim-footer">f</div>&lt;&amp;<br></body>') == "<body>x&lt;&amp;<br/></body>"
    assert clean("") == "" and clean("plain") == "plain" and clean("<body><b>open<i>x") == "<body><b>open<i>x</i></b></body>"
    assert len(clean("<div>" * 5000 + "x")) == 5000 * 11 + 1


def test_tokens_and_layout():
    assert list(H.tokens("a<B c=1>t</b>< >x>y<open")) == [(0, "text", "", False, "", "a"), (1, "tag", "b", False, "c=1", ""), (2, "text", "", False, "", "t"), (3, "tag", "b", True, "", ""), (4, "text", "", False, "", "x>y")]
    page = H.layout('<p>one <a href="/wiki/7">two words</a></p><img src="/img/4" w="20" h="50"/><ul><li>x</li></ul>')
    assert [(x[2], x[4]) for x in page.links] == [(4 * 7, 7), (5 * 7, 7)] and page.links[0][0] == 4 + 4 * 7
    assert page.images == [(4, page.images[0][1], 20, 50, 25)] and page.height > 0
    assert H.layout("w " * 200).height > H.layout("w").height == 16 and H.layout("").height == 0


def test_html_columns(spark):
    df = spark.createDataFrame([('<a href="/wiki/3">x</a><img h="8" src="/img/5" w="9"/><a class=q href="z">',)], "h string")
    r = df.select(H.entry_links("h").alias("l"), H.entry_images("h").alias("i"), H.hrefs("h").alias("r"), H.with_page_links("h", F.lit(1), F.lit(True)).alias("p")).first()
    texts = ["a<B c=1>t</b>< >x>y<open", "", "<><a/><>", "< a  b='1' >x</ a>", "<<p>"]
    lists = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", H.token_list("t").alias("l")).collect()
    rows = H.token_rows(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t", "k").orderBy("k", "place").collect()
    assert [(r["k"], *x) for r in lists for x in r["l"]] == [(r["k"], *r[2:]) for r in rows]
    for row in lists:
        assert [(k, *x) for k, x in enumerate(row["l"])] == [(seq, kind, name, closing, attrs, text) for seq, kind, name, closing, attrs, text in H.tokens(texts[row["k"]])]
    assert r["l"] == [3] and [tuple(x) for x in r["i"]] == [(5, 9, 8)] and r["r"] == ["/wiki/3", "z"] and "4294967294" in r["p"] and "4294967293" in r["p"]


# arithmetic


def test_keys_and_scrolling(spark):
    def key(x, y, shift=False, num=False):
        return spark.range(1).select(G.key_at(F.lit(x), F.lit(y), 96, F.lit(shift), F.lit(num)).alias("k")).first()["k"]

    assert [key(0, 96), key(319, 100, True), key(33, 100, True, True), key(20, 140), key(10, 180), key(300, 180), key(50, 185), key(100, 230), key(230, 230), key(5, 95), key(5, 240)] == ["q", "P", "@", "a", "\x01", "\b", "z", " ", "\r", None, None]
    r = spark.range(1).select(G.scroll_clamp(F.lit(900), F.lit(500)).alias("c"), G.thumb_height(F.lit(424)).alias("t"), G.thumb_top(F.lit(212), F.lit(424)).alias("y"), G.thumb_height(F.lit(212)).alias("n"), G.calibrated(F.lit(300), F.lit(3700), 20, 300, 0).alias("r")).first()
    assert tuple(r) == (288, 106, 134, None, 57 + 1)
    w, h = G.fitted(F.lit(640), F.lit(100), 320, 212)
    assert tuple(spark.range(1).select(w, h).first()) == (320, 50)
    shift = spark.range(1).select(G.shift_after(F.lit("A"), F.lit(1), F.lit(True), F.lit(False)).alias("a"), G.shift_after(F.lit("Q"), F.lit(0), F.lit(True), F.lit(False)).alias("b")).first()
    assert tuple(shift) == (False, True)


def test_random_states_of_lz4_never_crash():
    rnd = random.Random(9)
    for _ in range(2000):
        try:
            B.lz4_decompress(rnd.randbytes(rnd.randrange(30)), 64)
        except ValueError:
            pass
