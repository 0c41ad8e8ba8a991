"""Hard negatives, the Merkle manifest and bin completion against brute force."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offermatch.llm import bin_completion, merkle, threshold_join
from offermatch.llm.blocks import finite

PATH = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ hard negatives


def plain_negatives(rows, every, positives=5, negatives=3, low=50, high=95):
    seen = {}
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None for x in v):
            continue
        seen[key] = min(seen.get(key, (label, v)), (label, v))
    out = []
    for anchor, (label, v) in seen.items():
        if anchor % every:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w)), key, other) for key, (other, w) in seen.items() if key != anchor)
        for minus, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus]
            out += [(anchor, positive, rank, key, -minus, -score) for rank, (score, key, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    return sorted(map(tuple, threshold_join.hard_negatives(df, every, **more).collect()))


def vectors(seed, count, size=12, labels=4):
    random.seed(seed)
    centres = [[random.gauss(0, 60) for _ in range(size)] for _ in range(6)]
    return [(i, random.randrange(labels), [float(round(c + random.gauss(0, 50))) for c in random.choice(centres)])
            for i in range(count)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(threshold_join, "BLOCK_ROWS", 90)
    rows = vectors(3, 420)
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(120)]  # one very common vector
    rows += [(2000, 77, rows[5][2]), (2010, 0, [0.0] * 12), (2020, 1, [-x for x in rows[7][2]])]  # a lone label, zero, opposite
    assert mined(spark, rows, 10) == plain_negatives(rows, 10)


def test_negatives_of_odd_rows(spark):
    rows = vectors(4, 60) + [(None, 1, [1.0] * 12), (90, None, [1.0] * 12), (100, 1, None), (110, 1, [1.0] * 11),
                             (0, 0, [0.0] * 12), (20, 9, [2.0**40] * 12), ((1 << 53) + 10, 1, [5.0] * 12)]
    rows += rows[:15]  # repeated rows count once
    want = [r for r in rows if r[2] is not None and len(r[2]) == 12 and max(r[2]) < 2**39]
    assert mined(spark, rows, 10) == plain_negatives(want, 10)
    assert mined(spark, [], 10) == [] and mined(spark, [(1, 1, [1.0])], 10) == [] and mined(spark, [(0, 1, [1.0])], 10) == []
    assert mined(spark, [(1, 1, [])], 10) == []


def test_scores_beyond_doubles_are_exact(spark):
    near = [float(1 << 29), float((1 << 29) + 1), 1.0]
    rows = [(0, 0, near), (1, 0, near), (2, 1, [x * 0.75 for x in near[:2]] + [0.0]), (3, 1, [float(1 << 28)] * 2 + [3.0])]
    assert mined(spark, rows, 50) == plain_negatives(rows, 50)


def test_index_loses_no_pair():
    values = np.random.default_rng(1)
    exact = np.rint(values.normal(0, 40, (300, 21)) * (values.random(21) < 0.6)).astype(np.int64)
    order = np.argsort(-(exact**2).sum(axis=0), kind="stable")
    asked = exact[:40]
    scores = asked @ exact.T
    for share in (0.2, 0.5, 0.9, -1.0):
        least = share * np.linalg.norm(asked, axis=1) * 150
        floor = float((least / np.maximum(np.linalg.norm(asked, axis=1), 1)).min())
        index = threshold_join.Index(np.arange(300), exact, threshold_join.Plan(order, floor, True, 5))
        who, rows = index.pairs(asked[:, order].astype(float), least)
        found = set(zip(who.tolist(), index.ids[rows].tolist()))
        assert found >= set(zip(*(x.tolist() for x in np.nonzero(scores >= least[:, None]))))
        if share > 0:
            assert index.indexed.max() <= 3 and (share < 0.9 or len(found) < scores.size / 4)


def test_components_and_finiteness(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan")]), (3, [None, 1.0]), (4, None), (5, [float("-inf")])],
                                 "id long, v array<float>")
    assert [r["id"] for r in rows.where(finite(F.col("v"))).collect()] == [1]
    assert rows.limit(1).select(threshold_join.whole_components(F.col("v")).alias("w")).first()["w"] == [128, -1]


# ------------------------------------------------------------------ manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fields=merkle.FIELDS, altered=lambda row: False):
    """rows: dicts; the definition, with no layout and no blocks."""
    def leaf(row, lower=False):
        parts = []
        for f in fields:
            value = row[f]
            if lower and f == "text" and value is not None:
                value = "".join(c.lower() if "A" <= c <= "Z" else c for c in value)
            parts.append("-" if value is None else f"{len(str(value).encode())}:{value}")
        return h(*parts)

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            out.append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            i //= 8
        return out

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang),
                      key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = mine, climb([leaf(r) for r in mine])
    forest = climb([trees[lang][1][-1][0] for lang in langs])
    out = []
    for at, lang in enumerate(langs):
        mine, levels = trees[lang]
        for i, row in enumerate(mine):
            whole = path(levels, i) + path(forest, at)
            digest = leaf(row, altered(row))
            for a, b in whole:
                digest = h(a, digest, b)
            root = forest[-1][0]
            out.append((row["doc_id"], leaf(row), levels[-1][0], root, h(*[a + b for a, b in whole]), digest, digest == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def documents(langs):
    rows = []
    for lang, count in langs.items():
        for i in range(count):
            rows.append({"doc_id": len(rows) * 7 % 10007, "source": random.choice(["a", None, "ü"]), "lang": lang,
                         "n_chars": random.choice([None, i]), "text": random.choice([None, "", f"Doc {i}", "äß😀 x" * (i % 5), "lower"])})
    return rows


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_equals_the_definition(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "RUN", 8**height)
    random.seed(9)
    langs = {"en": 600, None: 9, "de": 1, "": 8, "zhé": 65}
    langs.update({f"l{i}": 1 + i % 3 for i in range(20 if height == 1 else 4)})
    rows = documents(langs)
    rows += [dict(rows[3]), dict(rows[3]), {**rows[3], "doc_id": None}, {**rows[4], "text": "A" * 300_000}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumns({"TREE": F.lit(1), "Leaf": F.lit("x")})
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(df, altered=(tampered, "text")).collect()
    want = plain_manifest(rows, altered=lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df).collect() == []
    rows = documents({"en": 1})
    got = merkle.manifest(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)).collect()
    assert [tuple(r) for r in got] == plain_manifest(rows)
    assert got[0]["leaf"] == got[0]["subroot"] == got[0]["root"]


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_layout(levels):
    places = merkle.addresses(levels)
    assert [len(p) for p in places] == [8**d for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.size_of(levels)))
    top, low = levels // 2, levels - levels // 2
    if top:  # a bottom subtree is one stretch
        size = merkle.size_of(low)
        for d in range(top, levels):
            inside = (places[d] - merkle.size_of(top)) // size
            assert (inside == np.arange(8**d) // 8**(d - top)).all()


@pytest.mark.parametrize("leaves,height", [(1, 0), (8, 1), (3, 1), (64, 2), (9, 2), (513, 4), (4096, 4)])
def test_block_round_trip(leaves, height):
    digests = [sha256(str(i).encode()).digest() for i in range(leaves)]
    block = merkle.Block.of(digests, height)
    again = merkle.Block.from_bytes(block.to_bytes(), height, leaves)
    assert again.root == block.root
    paths = again.paths()
    assert all(merkle.folded(d.hex(), p) == block.root.hex() for d, p in zip(digests, paths))


# ------------------------------------------------------------------ bin completion


def optimum(sizes, capacity):
    best, ordered = [len(sizes)], sorted(sizes, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(ordered):
            best[0] = len(rooms)
            return
        for b in range(len(rooms)):
            if rooms[b] >= ordered[i]:
                rooms[b] -= ordered[i]
                go(i + 1, rooms)
                rooms[b] += ordered[i]
        go(i + 1, [*rooms, capacity - ordered[i]])

    go(0, [])
    return best[0]


def test_search_finds_the_fewest_bins():
    random.seed(5)
    beaten = 0
    for _ in range(600):
        capacity = random.choice([10, 20, 30, 50, 100])
        sizes = [random.randint(1, capacity) if random.random() < 0.5 else random.randint(capacity // 4, capacity // 2 + 1)
                 for _ in range(random.randint(0, 10))]
        search = bin_completion.Search(sizes, capacity)
        best = optimum(sizes, capacity)
        assert sorted(x for b in search.bins for x in b) == sorted(sizes)
        assert all(sum(b) <= capacity for b in search.bins)
        assert search.exact and len(search.bins) == best >= search.bound
        beaten += len(bin_completion.best_fit_decreasing(sizes, capacity)) > best
    assert beaten  # the search is needed


def test_search_that_runs_out_keeps_the_best_so_far():
    random.seed(6)
    sizes = [random.randint(300, 1200) for _ in range(800)]
    first = len(bin_completion.best_fit_decreasing(sizes, 2048))
    for effort in (0, 1, 50, 5000):
        search = bin_completion.Search(sizes, 2048, effort)
        assert sorted(x for b in search.bins for x in b) == sorted(sizes)
        assert search.bound <= len(search.bins) <= first and all(sum(b) <= 2048 for b in search.bins)


def test_domination():
    bits = lambda *sizes: sum(1 << s for s in sizes)
    assert bin_completion.dominated([3], bits(4), 1)  # 4 in the place of 3
    assert bin_completion.dominated([2, 3], bits(5), 0)  # one for two
    assert bin_completion.dominated([3], bits(2), 2)  # fits beside
    assert not bin_completion.dominated([5], bits(5, 2), 0)
    assert not bin_completion.dominated([4, 4], bits(7), 0)


@pytest.mark.parametrize("group", [7, 4096])
def test_packed_whole_documents(spark, monkeypatch, group):
    monkeypatch.setattr(bin_completion, "GROUP_PIECES", group)
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "word " * 30, "a b c d e " * 700, "word " * 63] + [f"text {i} " * (i % 17) for i in range(60)]
    rows = [(i % 50, t) for i, t in enumerate(texts)] + [(None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"PIECE": F.lit(1), "unit": F.lit("u"), "group": F.lit(2)})
    got = bin_completion.packed_whole(df, PATH, 0, 64, keep_ids=True).collect()
    ids = {}
    for r in got:
        piece = np.frombuffer(r["ids"], "<u4")
        assert len(piece) == r["length"] <= 64 and zlib.crc32(piece) == r["ids_crc32"]
        ids.setdefault(r["doc_id"], []).append(r)
    want = {}
    for key, text in rows:
        want.setdefault(key, []).append(library.encode(text or "", add_special_tokens=False).ids + [0])
    for key, whole in want.items():
        mine = sorted(ids[key], key=lambda r: (r["piece"], r["length"]))
        assert sum(r["length"] for r in mine) == sum(map(len, whole))
        if len(whole) == 1:
            assert [i for r in mine for i in np.frombuffer(r["ids"], "<u4").tolist()] == whole[0]
            assert [r["piece"] for r in mine] == list(range(len(mine)))
            assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:i]) for i in range(len(mine))]
            assert len(mine) == -(-len(whole[0]) // 64) and all(r["length"] == 64 for r in mine[1:])
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(w) for ws in want.values() for w in ws)
    if group == 4096:
        sizes = [(len(w) - 1) % 64 + 1 for ws in want.values() for w in ws]
        full = sum(len(w) > 64 and (len(w) - 1) // 64 for ws in want.values() for w in ws)
        assert len(sequences) <= full + len(bin_completion.best_fit_decreasing(sizes, 64))
    else:
        assert len(sequences) <= -(-total // 64) * 1.25 + 2
    assert bin_completion.packed_whole(df.limit(0), PATH, 0, 64).collect() == []
