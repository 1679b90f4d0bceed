"""Token files and BPE coding against the plain library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from keystrata.llm import bpe, token_files
from keystrata.llm.tokenizing import Bytes, Pieces, id_bytes, tokenizer

from .conftest import ODD

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "Bc", "'s", "'", "re", "don't", " ", "  ", "\n", "\t", "12", "é", "ß", "<|endoftext|>", "<|endof", "text|>", ".", ",", "!!", "日本", "😀", " ", "́", "İ", "ſ", "\x1c", "\x85", "Ω.", "ab.,", "x***", "ǅ", "x" * 70]


def mixes(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def plain(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaces", [(WORDS, False), (BYTES, True)])
def test_pieces_equal_whole_texts(path, spaces):
    pieces = Pieces(path, spaces, 10_000)
    texts = mixes(1500, 1) + ["x" * 100_000, "=" * 100_000]
    assert [b"".join(v) for v in pieces.values(texts)] == [id_bytes(plain(path, t)) for t in texts]
    assert all(len(k) <= 64 for m in (pieces.pieces, pieces.parts) for d in (m.young, m.old) for k in d)
    assert sum(len(d) for m in (pieces.pieces, pieces.parts) for d in (m.young, m.old)) < 4 * 10_000 / 190


def test_bytes_decode_as_the_library():
    own, draw = Bytes(BYTES), random.Random(3)
    for _ in range(300):
        ids = [draw.randrange(len(own.of)) for _ in range(draw.randint(0, 40))]
        assert own.decode(ids) == tokenizer(BYTES).decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("n", [0, 1, 1000, (1 << 17) + 3])
def test_decimal_ids_and_long_decoding(n):
    own = Bytes(BYTES)
    ids = np.random.default_rng(n).integers(0, len(own.of), n, dtype=np.uint32)
    assert own.decimal(ids) == ",".join(map(str, ids.tolist())).encode()
    assert own.decode(ids) == b"".join(own.of[i] for i in ids.tolist()).decode("utf-8", "replace")


def test_words_are_kept_once():
    path, pieces, texts = BYTES, Pieces(BYTES, True), ["House, House. House\nHouse! caf\u00e9? caf\u00e9 caf\u00e9"]
    assert [b"".join(v) for v in pieces.values(texts)] == [id_bytes(plain(path, t)) for t in texts]
    assert not any(c.isalpha() for k in pieces.parts.young for c in k)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = token_files.pack(ids, bits)
    assert len(planes) == (32 if bits else 4)
    assert (token_files.unpack(planes, n, bits) == ids).all()


@pytest.mark.parametrize("bits,block", [(False, 64), (True, 1000), (False, 1 << 16)])
def test_token_files(spark, odd, tmp_path, bits, block):
    token_files.write_ids(odd, f"file://{tmp_path}/t", WORDS, 2, block_ids=block, bits=bits)
    got = [(r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_ids(spark, f"file://{tmp_path}/t").orderBy("start").collect()]
    want, start = [], 0
    for key, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = id_bytes([*plain(WORDS, text), 2])
        want.append((key, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    assert got == want


def test_token_files_of_nothing(spark, empty, tmp_path):
    token_files.write_ids(empty, f"file://{tmp_path}/t", WORDS, 2)
    assert token_files.read_ids(spark, f"file://{tmp_path}/t").count() == 0


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 20, 64])
def test_tree_equals_whole(leaf):
    own, draw = bpe.Encoder(BYTES), random.Random(leaf)
    runs = ["a", "ab", "the", "ing", "  ", " ", "!", "'", "s", "1", "é", "日", "<|endoftext|>", "=", "==", "\n", "'re", "\t"]
    for k in range(80):
        text = draw.choice("a =ab日' ") * draw.randint(1, 300) if k % 5 == 0 else "".join(draw.choice(runs if k % 3 else runs[:4]) for _ in range(draw.randint(0, 200)))
        parts = bpe.leaves(text, leaf)
        assert "".join(parts) == text
        assert own.tree([own.plain(x) for x in parts]) == plain(BYTES, text)
    assert own.windows


def test_long_runs_are_joined_by_levels(spark):
    """Runs of 100,000 characters without a place to cut, through leaves, windows and three levels of tasks."""
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdefghij") for _ in range(100_000)), "=" * 100_000, "ab" * 50_000, "日" * 100_000, " " * 100_000, "x" * 99_999 + " 's", "words and 'tis " * 7000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["key"]: r for r in bpe.code(df, BYTES, fan=5).collect()}
    for k, text in enumerate(texts):
        assert got[k]["ids"] == plain(BYTES, text) and got[k]["windows"] >= 12
        assert got[k]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_no_task_runs_the_join_and_the_root(spark, odd):
    """Workers stay with a busy executor, so that no stage may start two for a task."""
    plan = bpe.code(odd, BYTES, long_chars=50, leaf_chars=16)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("long_chars,leaf", [(50, 16), (1 << 16, 1 << 14)])
def test_code(odd, long_chars, leaf):
    got = sorted((r["key"] is None, r["key"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in bpe.code(odd, BYTES, long_chars=long_chars, leaf_chars=leaf).collect())
    want = []
    for key, text, *_ in ODD:
        ids = plain(BYTES, text)
        decoded = tokenizer(BYTES).decode(ids, skip_special_tokens=False)
        want.append((key is None, key or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids)))
    assert got == sorted(want)


def test_code_of_nothing(empty):
    assert bpe.code(empty, BYTES).count() == 0
