import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quire.llm import packing, rans, tokens
from quire.llm.arrays import buffers
from quire.llm.bytebpe import Encoder, vocabulary
from quire.llm.queries import op3_best_fit_packing, op5_bpe_round_trip, op7_token_files, tokenizer_path

PATH = tokenizer_path()
ALPHABET = st.one_of(
    st.sampled_from(["'s", "'re", "'LL", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "12", "½", "_", "…", "<|endoftext|>", "中文", "한", "😀", "́", "aaaa", "the", "ʼ", "\0"]),
    st.text(max_size=3),
)
TEXTS = st.lists(st.lists(ALPHABET, max_size=12).map("".join), max_size=6)
ROWS = [(1, "the cat's hat, we'll see"), (2, None), (3, ""), (4, "x" * 30000), (4, "the cat's hat, we'll see"), (None, "a b"), (5, "<|endoftext|> tail"), (6, "word " * 5000)]


def library_ids(texts):
    return [x.ids for x in vocabulary(PATH).library.encode_batch(texts, add_special_tokens=False)]


def own_ids(encoder, texts):
    out = []
    for i, j, ids, first in encoder.encode_all(*buffers(pa.array(texts, pa.string())), limit=50):
        out += [ids[first[k] : first[k + 1]].tolist() for k in range(j - i)]
    return out


@pytest.mark.parametrize("merge", ["compiled", "pair_index"])
@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_ids_equal_the_library(merge, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert own_ids(Encoder(PATH, merge), texts) == library_ids(texts)


@pytest.mark.parametrize("merge", ["compiled", "pair_index"])
def test_other_scripts_and_special_tokens(merge):
    """Nothing goes through the library but the classes of characters that this Python's Unicode data lacks."""
    lines = ["مرحبا بالعالم ١٢٣", "שלום עולם", "नमस्ते दुनिया १२", "สวัสดีชาวโลก", "Γειά σου Κόσμε", "𐵀𐵁x \U000105c0\U000105c1 \U00010d41", "\u0378a \U000e0fffb 1\u0378"]
    special = "<|endoftext|>"
    texts = [*lines, " ".join(lines), f"a{special}", f"{special} b", f"it{special}'s {special}{special} 12{special}x", "<|endoftext|", f"<{special}>", special]
    encoder = Encoder(PATH, merge)
    library = encoder.vocab.library
    want = library_ids(texts)
    encoder.vocab.library = type("Splitter", (), {"pre_tokenizer": library.pre_tokenizer})()
    try:
        assert own_ids(encoder, texts) == want
    finally:
        encoder.vocab.library = library


def test_every_assigned_character_has_the_librarys_class():
    from quire.llm import bytebpe

    rnd, vocab = np.random.default_rng(2), vocabulary(PATH)
    table = bytebpe._classes()
    known = np.flatnonzero(table != bytebpe.UNSURE)
    known = known[(known < 0xD800) | (known > 0xDFFF)]
    for c in rnd.choice(known, 3000, replace=False).tolist():
        if table[c] != bytebpe.SPACE:
            assert vocab.class_of(chr(c)) == table[c], hex(c)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, piece string, start int")


def test_round_trip(spark, tiny):
    got = {r["doc_id"]: r for r in op5_bpe_round_trip(spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d, ids in zip(docs, library_ids([d["text"] for d in docs]), strict=True):
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(vocabulary(PATH).library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_frames(spark):
    df = frame(spark, ROWS)
    back = tokens.decoded(tokens.encoded(df, PATH), PATH).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in ROWS)
    assert tokens.round_trip(df.limit(0), PATH).count() == 0


def check_files(rows, got):
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library_ids([t or ""])[0], 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(got, key=lambda r: r["start"])
    assert Counter(want) == Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_token_files(spark, tiny, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check_files(docs, op7_token_files(spark, tiny).collect())
    rans.write_token_files(frame(spark, ROWS), str(tmp_path / "a"), PATH)
    check_files(ROWS, rans.read_token_files(spark, str(tmp_path / "a")).collect())
    rans.write_token_files(frame(spark, ROWS).limit(0), str(tmp_path / "b"), PATH)
    assert rans.read_token_files(spark, str(tmp_path / "b")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=3000), st.integers(1, 50))
def test_file_round_trip(ids, times):
    ids = np.array(ids * times, np.int32)
    head, blocks = rans.pack_file(ids)
    assert (rans.Reader(head).range(blocks, 0, len(ids)) == ids).all()


def test_parts_are_read_without_the_rest():
    rng = np.random.default_rng(7)
    ids = rng.zipf(1.3, 300_000).clip(0, 50_000).astype(np.int32)
    head, blocks = rans.pack_file(ids)
    assert len(blocks) == 3
    middle = rans.Reader(head).block(blocks[1])
    assert (middle == ids[rans.BLOCK_TOKENS : 2 * rans.BLOCK_TOKENS]).all()
    broken = [b"", blocks[1], b""]  # the others are not there
    for a, b in ((rans.BLOCK_TOKENS + 70_000, rans.BLOCK_TOKENS + 70_010), (rans.BLOCK_TOKENS + 65_535, rans.BLOCK_TOKENS + 65_537), (rans.BLOCK_TOKENS, rans.BLOCK_TOKENS + 1)):
        assert (rans.Reader(head).range(broken, a, b) == ids[a:b]).all()
    assert (rans.Reader(head).range(blocks, 131_000, 263_000) == ids[131_000:263_000]).all()
    n_marks = int.from_bytes(blocks[1][4:8], "little")
    words_at = 12 + rans._MARK * n_marks
    spoilt = blocks[1][:words_at] + bytes(64) + blocks[1][words_at + 64 :]  # words before the second checkpoint are lost
    assert (rans.Reader(head).block(spoilt, 65_536, 66_000) == middle[65_536:66_000]).all()


def test_blocks_and_documents_of_files(spark, tmp_path):
    path = str(tmp_path / "files")
    rans.write_token_files(frame(spark, ROWS), path, PATH)
    want = [np.array([*library_ids([t or ""])[0], 2]) for _, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))]
    blocks = rans.read_blocks(spark, path).orderBy("part", "seq", "block").collect()
    assert sorted(x for r in blocks for x in r["ids"]) == sorted(np.concatenate(want).tolist())
    asked = spark.createDataFrame([(4,), (6,), (77,), (4,)], "doc_id long")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in rans.read_documents(spark, path, asked).collect())
    assert got == Counter((i, tuple([*library_ids([t or ""])[0], 2])) for i, t in ROWS if i in (4, 6))
    rans.write_token_files(frame(spark, ROWS).selectExpr("concat('d', doc_id) AS doc_id", "text"), str(tmp_path / "named"), PATH)
    named = rans.read_token_files(spark, str(tmp_path / "named"))
    assert named.schema["doc_id"].dataType.simpleString() == "string" and named.count() == len(ROWS)


def test_a_broken_block_is_found():
    head, blocks = rans.pack_file(np.arange(5000, dtype=np.int32))
    image = bytearray(blocks[0])
    image[-9] ^= 1
    with pytest.raises(ValueError):
        rans.Reader(head).block(bytes(image))


def brute_force(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


def check_packing(rows, got, size):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for i, t in rows:
        ids, at = [*library_ids([t or ""])[0], 2], 0
        for k, n in enumerate(packing.cut(len(ids), size)):
            want[(i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at += n
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    rooms = []
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
        rooms.append(size - at)
    assert sorted(rooms) == brute_force([r["length"] for r in got], size)


def test_packing(spark, tiny):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check_packing(docs, op3_best_fit_packing(spark, tiny).collect(), 1024)
    check_packing(ROWS, packing.packed(frame(spark, ROWS), PATH, 64).collect(), 64)
    assert packing.packed(frame(spark, ROWS).limit(0), PATH).count() == 0
    alike = frame(spark, [(1, "the same row")] * 500)
    check_packing([(1, "the same row")] * 500, packing.packed(alike, PATH, 64).collect(), 64)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda s: st.tuples(st.just(s), st.lists(st.integers(1, s), max_size=60))))
def test_best_fit_decreasing_equals_brute_force(case):
    size, lengths = case
    runs, n = packing.best_fit_decreasing(Counter(lengths), size)
    rooms = defaultdict(lambda: size)
    for length, count in Counter(lengths).items():
        own = [r for r in runs if r.length == length]
        for rank in range(count):
            r = [x for x in own if x.first <= rank][-1]
            rooms[r.bin + (rank - r.first) // r.per] -= length
    assert sorted(rooms.values()) == brute_force(lengths, size) and len(rooms) == n
