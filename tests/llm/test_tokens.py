import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from reckon.llm import bpe, token_files
from reckon.llm.common import text_bytes
from reckon.llm.pretokens import KINDS, PieceCache, pieces

from .conftest import prose

SAMPLES = [
    "", "don't can't we'll they've I'm he'd 'sam ''s !'s \"'tis'\" 'llama 're' 'r 's\n's", "Hello  WORLD\n\t x123 4,5  ", "  a\n\n b \n", "naïve Ünïcode ÑANDÚ İstanbul Ⱥ ß", "日本語 😀 é ﬁ Σας ΣΑΣ",
    "a<|endoftext|>b<|startoftext|> c <|x|>", "x\xa0y z\u0085w", "1²½Ⅷ٣", "\x00\x01", "a" * 300, "!?..,,--''", " \t\n", "\n \nx", prose(3, 400),
]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(token_files.vocabulary_path())


def test_forced_boundaries_equal_the_library(word_library):
    own = bpe.load(bpe.vocabulary_path())
    for text, ids in zip(SAMPLES, own.encode(SAMPLES)):
        want = word_library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode([ids])[0].as_py().decode() == word_library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("aé's ß1!\n tTrRvVeElLdDmM", max_size=60), min_size=1, max_size=4))
def test_any_text_equals_the_library(word_library, byte_library, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [x.tolist() for x in bpe.load(bpe.vocabulary_path()).encode(texts)] == [word_library.encode(t, add_special_tokens=False).ids for t in texts]
    own = token_files.load(token_files.vocabulary_path()).encode(texts)
    assert [x.tolist() for x in own] == [byte_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_equal_polynomial_hash(word_library, byte_library):
    signs = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    pair = [signs, signs.translate(str.maketrans("ab", "ba"))]
    for made, library in ((bpe.WordBPE(bpe.vocabulary_path()), word_library), (token_files.LibraryTokenizer(token_files.vocabulary_path()), byte_library)):
        want = [library.encode(t, add_special_tokens=False).ids for t in pair]
        assert [x.tolist() for x in made.encode(pair)] == want and want[0] != want[1]
        assert [made.encode([t])[0].tolist() for t in pair] == want


def test_pieces_outlive_a_generation():
    asked = []

    def encode(raws):
        asked.extend(raws)
        return np.array([len(r) for r in raws], np.uint32), np.ones(len(raws), np.int64)

    cache = PieceCache(encode, room=3)
    for text in ("a bb ccc dddd", "a bb", "ee ff gg hh", "a bb"):
        raw, offsets = text_bytes(pa.array([text]))
        starts, ends, _ = pieces(raw, offsets, KINDS[raw], spaced=False)
        ids, size = cache.ids(raw, starts, ends)
        assert ids.tolist() == [len(w) for w in text.split()] and size.tolist() == [1] * len(ids)
    assert sorted(asked) == [b"a", b"bb", b"ccc", b"dddd", b"ee", b"ff", b"gg", b"hh"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 70_000) | st.integers(0, 2**64 - 1), max_size=400))
def test_words_round_trip(ids):
    got = token_files.unpack(token_files.pack(np.array(ids, np.uint64)))
    assert got.tolist() == ids


def test_escapes_of_any_top_bits():
    ids = [1, 2**64 - 1, 15 << 60, 0, 1 << 60, 7]
    assert token_files.unpack(token_files.pack(np.array(ids, np.uint64))).tolist() == ids


def test_files(spark, odd, byte_library, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    shards = token_files.write(odd, token_files.vocabulary_path(), folder)
    got = sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in token_files.read(spark, folder, shards).collect()), key=lambda r: r[1])
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for doc_id, text in rows:
        ids = byte_library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want


def test_no_documents(spark, none, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    assert token_files.read(spark, folder, token_files.write(none, token_files.vocabulary_path(), folder)).count() == 0
    path = bpe.vocabulary_path()
    assert bpe.decode(bpe.encode(none, path), path).count() == 0


def test_queries(spark, word_library, byte_library):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in bpe.op4_bpe(spark, folder).collect():
        ids = word_library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = word_library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op3_token_files(spark, folder).collect()}
    at = 0
    for doc_id in sorted(docs):
        ids = byte_library.encode(docs[doc_id], add_special_tokens=False).ids + [0]
        assert got[doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows(odd):
    path = bpe.vocabulary_path()
    got = bpe.decode(bpe.encode(odd, path), path)
    assert set(odd.columns) <= set(got.columns) and got.count() == odd.count()
    assert {r["decoded"] for r in got.where("text IS NULL OR trim(text) = ''").collect()} == {""}
