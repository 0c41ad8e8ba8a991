"""Token counts, token files and packing against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offermatch.llm import packing, token_counts, token_files
from offermatch.llm.pieces import BLOCK, Memo
from offermatch.llm.token_ids import TokenEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a" * 3000, "x " * 2000, "ab<|endoftext|>cd ", "it's 'round  \t'll", "é中😀 ١٢", "'r"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(PATH)


@pytest.fixture(scope="module")
def encoder():
    return TokenEncoder(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def words(seed, count):
    random.seed(seed)
    letters = list("aelrvstmd'' \n\t1!é中😀Z.") + ["<|endoftext|>", "'re", "  ", "tion"]
    return ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(count)]


def test_counts_and_ids_equal_the_library(library, counter, encoder):
    texts = words(1, 4000) + [t or "" for t in ODD] + ["a" * 511, "b" * 512 + "'r", "c" * 510 + "  d"]
    want = [ids_of(library, t) for t in texts]
    assert counter.counts(texts) == [len(w) for w in want]
    assert [np.frombuffer(b, "<u2").tolist() for b in encoder.encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, counter, text):
    assert counter.counts([text]) == [len(ids_of(library, text))]


def test_character_classes_are_the_tokenizers_own(library, counter):
    split = library.pre_tokenizer.pre_tokenize_str
    for point in [*range(0x600), *range(0x2000, 0x2100), 0x3000, 0x10D4A, 0x1E900, 0x31350, 0x1FAE9]:
        text = f"a{chr(point)}1"
        want = [b for _, (b, _) in split(text)]
        assert counter.splitter.begins(text).tolist() == want, hex(point)


def test_state_maps_compose(counter):
    """A text cut into chunks anywhere gives the pieces of the whole."""
    splitter = counter.splitter
    count = len(splitter.maps)
    for a in range(count):
        for b in range(count):
            assert (splitter.maps[splitter.compose[a, b]] == splitter.maps[b][splitter.maps[a]]).all()


def test_text_longer_than_a_block(library, counter, monkeypatch):
    from offermatch.llm import pieces

    monkeypatch.setattr(pieces, "BLOCK", 50)
    text = "".join(words(5, 60)).replace("<|endoftext|>", "") + "z" * 400
    assert counter.counts([text]) == [len(ids_of(library, text))]
    assert BLOCK > 50


def test_forgetting_changes_nothing(library):
    small = token_counts.TokenCounter(PATH)
    small.memo = Memo({s: 1 for s in small.splitter.special}, small._count, room=5)
    texts = words(7, 300)
    for part in range(0, 300, 50):
        got = small.counts(texts[part:part + 50])
        assert got == [len(ids_of(library, t)) for t in texts[part:part + 50]]


def rows(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")


def test_token_counts_frame(spark, library):
    df = rows(spark, ODD + ["again", "again"], [*range(len(ODD)), None, None]).selectExpr(
        "doc_id", "text", "7 as N_TOKENS", "'k' as over_limit")
    got = token_counts.token_counts(df, PATH, limit=3)
    assert got.columns == ["doc_id", "text", "N_TOKENS", "over_limit", "n_bytes", "n_tokens_", "over_limit_"]
    for r in got.collect():
        n = len(ids_of(library, r["text"]))
        assert (r["n_tokens_"], r["over_limit_"], r["n_bytes"]) == (n, n > 3, len((r["text"] or "").encode()))
        assert (r["N_TOKENS"], r["over_limit"]) == (7, "k")
    assert got.count() == len(ODD) + 2
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    numbers = np.cumsum([0, *steps])
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.of(numbers).to_bytes())
    assert list(code) == numbers.tolist()
    for i in {0, len(numbers) - 1, len(numbers) // 2}:
        assert code.select(i) == numbers[i]


def test_elias_fano_is_small_and_selects_anywhere():
    numbers = np.cumsum(np.random.default_rng(1).integers(0, 1000, 20_000))
    code = token_files.EliasFano.of(numbers)
    assert [code.select(i) for i in range(0, 20_000, 97)] == numbers[::97].tolist()
    assert len(code.to_bytes()) * 8 < len(numbers) * 13  # 64 in a plain table
    gaps = np.cumsum([0, *[0] * 300, 10**9, *[1] * 300])
    assert token_files.EliasFano.of(gaps).select(301) == 10**9


def test_token_files_round_trip(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    ids = [5, None, 3, 3, None, 9, -2, 7, 8, 6]
    df = rows(spark, ODD, ids).unionAll(rows(spark, ["same", "same"], [3, 3]))
    path = str(tmp_path / "files")
    token_files.write_token_files(df, path, PATH, end_id=2)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys) and len(got) == 12
    at = 0
    sums = sorted((k or 0, zlib.crc32(np.array([*ids_of(library, t), 2], "<u4").tobytes()))
                  for k, t in zip(ids + [3, 3], ODD + ["same", "same"]))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in got) == sums
    some = token_files.read_token_files(spark, path, wanted=[3, -2, 9, 3, 4, 2**60]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in got if r["doc_id"] in (3, -2, 9))
    empty = str(tmp_path / "empty")
    token_files.write_token_files(df.limit(0), empty, PATH, end_id=2)
    assert token_files.read_token_files(spark, empty).count() == 0
    assert token_files.read_token_files(spark, empty, wanted=[3]).count() == 0


def test_token_files_of_odd_columns_and_ids(spark, library, tmp_path):
    """Columns with the names of the format, and ids from one end of the longs to the other."""
    ids = [-2**63, 2**63 - 1, 0, None, 2**53, 2**53 + 1]
    df = rows(spark, ["one", "two", None, "", "five", "six " * 5000], ids)
    df = df.selectExpr("*", "1 as shard", "'x' as ids", "2 as n_null", "doc_id as k", "text as t")
    path = str(tmp_path / "files")
    token_files.write_token_files(df.coalesce(1), path, PATH, end_id=2)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -2**63, 0, 2**53, 2**53 + 1, 2**63 - 1]
    lengths = dict(zip(ids, ["one", "two", "", "", "five", "six " * 5000]))
    assert [r["n_tokens"] for r in got] == [len(ids_of(library, lengths[r["doc_id"]])) + 1 for r in got]
    ends = token_files.read_token_files(spark, path, wanted=[2**63 - 1, -2**63]).collect()
    assert sorted(r["doc_id"] for r in ends) == [-2**63, 2**63 - 1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_first_fit_decreasing(sizes):
    room = []
    want = [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_ = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
        if bin_ == len(room):
            room.append(64)
        want[i] = (bin_, 64 - room[bin_])
        room[bin_] -= sizes[i]
    assert list(zip(*packing.first_fit_decreasing(sizes, 64))) == want


def test_packing(spark, library):
    texts = ODD + words(11, 200)
    df = rows(spark, texts, [None, None, *range(len(texts) - 2)]).selectExpr("*", "1 as unit", "2 as offset")
    got = packing.packed_documents(df, PATH, end_id=0, length=128, keep_ids=True)
    placed = got.collect()
    total = sum(len(ids_of(library, t)) + 1 for t in texts)
    assert sum(r["length"] for r in placed) == total
    by_sequence = {}
    for r in placed:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None:
            whole = [*ids_of(library, texts[r["doc_id"] + 2]), 0]
            assert ids.tolist() == whole[r["start"]:r["start"] + r["length"]] and r["doc_tokens"] == len(whole)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by_sequence) * 128 < 1.1 * total
    made = packing.sequences(got, 128).collect()
    assert len(made) == len(by_sequence)
    assert all(len(r["ids"]) == 128 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in made)
    assert packing.packed_documents(df.limit(0), PATH).count() == 0


def test_memo_is_bounded_by_letters():
    """A memo was once bounded by entries alone, whatever their length."""
    from offermatch.llm.pieces import Memo

    made = []
    memo = Memo({"<s>": 7}, lambda pieces: [made.append(p) or len(p) for p in pieces], room=1000, letters=5000)
    for i in range(60):
        long = str(i) * 400
        assert memo.values([long, "<s>", "a", long]) == [len(long), 7, 1, len(long)]
        assert memo.values(["a"]) == [1] and memo.values([]) == []
        assert sum(map(len, [*memo.new, *memo.old])) <= 2 * (5000 + 1200)
    assert made.count("a") == 1
