"""SimHash links and multi-index hashing against brute force; the pipeline; the SQL counterparts."""

import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from offermatch.llm import multi_index, oracles, simhash
from offermatch.sources.bridge import TABLES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)][:len(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [least.get(find(i)) for i in range(len(ids))]


def test_near_duplicates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    texts = [r["text"] for r in docs]
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, texts[0]), (None, "ÄÖ one"), (9003, "ÄÖ ONE"), (9004, "a b"),
             (9004, "a b"), (9005, texts[3] * 40)]
    rows += [(9100 + i, texts[5] + " more" * (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df.withColumn("FP", F.lit(1))).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([k for k, _ in rows], prints)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(
        ((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, want)), key=key)
    clashing = df.withColumns({"ROW_KEY_A": F.lit(1), "row": F.lit(2), "fp": F.lit(3)})
    assert simhash.deduplicated(clashing).columns == clashing.columns
    kept = simhash.deduplicated(clashing).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for c in want})
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_pigeonring_loses_no_pair():
    random = np.random.default_rng(2)
    base = random.integers(0, 2**63, 60, np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in random.choice(64, random.integers(0, 4), False)) for b in base]
    prints = np.unique(np.array([*base.tolist(), *near], np.uint64))
    found = set()
    bits = simhash.exact_segments() * simhash.STEP
    for turn in range(simhash.SEGMENTS):
        n = np.uint64(turn * simhash.STEP)
        ring = (prints >> n) | (prints << (np.uint64(64) - n)) if turn else prints
        keys = (ring & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        for a, b in simhash.close_pairs(keys[order], ring[order]):
            found |= {frozenset((int(prints[order[i]]), int(prints[order[j]]))) for i, j in zip(a, b)}
    want = {frozenset((int(a), int(b))) for i, a in enumerate(prints) for b in prints[:i]
            if bin(int(a) ^ int(b)).count("1") <= 3}
    assert found == want and len(want) >= 40


def test_dense_group_gives_spanning_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LINKS", 1000)
    prints = [0] + [1 << i for i in range(64)] + [3 << i for i in range(63)]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    groups = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.links(groups)
    assert links.count() < 16 * len(prints) * 2
    stars = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert set(stars.values()) == {min(signed)} and len(stars) == len(prints) - 1


def test_long_chains_settle(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}


def brute_force(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted(((float(v @ w), -j) for j, w in good if j != i), reverse=True)[:k]
    return out


def test_nearest_rows(spark):
    random = np.random.default_rng(4)
    centres = random.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * random.standard_normal(16)).tolist()) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(60)]
    rows += [(900, None), (920, [0.0] * 16), (940, [float("nan")] + [1.0] * 15), (960, [None] + [1.0] * 15), (980, [1.0] * 3),
             (None, rows[0][1]), (1000, [float("inf")] * 16), (1020, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("RANK", F.lit(0))
    want = brute_force(rows, 20, 20)
    got = {}
    for r in multi_index.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], -r["vec_id"]))
    assert got.keys() == want.keys()
    assert all(len(v) == 20 and v == sorted(v, reverse=True) for v in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    few = spark.createDataFrame(rows[:5], df.drop("RANK").schema)
    assert multi_index.nearest(few).count() == 4
    assert multi_index.nearest(few.limit(0)).count() == 0


def recall(spark, ids, vectors, every, k=20):
    df = spark.createDataFrame(list(zip(ids, vectors.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.nearest(df, k, every).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    place = {i: at for at, i in enumerate(ids)}
    hits = 0
    for q in got:
        scores = vectors @ vectors[place[q]]
        scores[place[q]] = -np.inf
        hits += len(got[q] & {ids[i] for i in np.argsort(-scores, kind="stable")[:k]})
    assert all(len(found) == k for found in got.values())
    return hits / (k * len(got))


def test_a_dense_group_of_first_ids_does_not_set_the_radius(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 1500)
    random = np.random.default_rng(5)
    centres = random.standard_normal((200, 64))
    vectors = centres[random.integers(0, 200, 6_000)] + 0.5 * random.standard_normal((6_000, 64))
    vectors[:300] = vectors[0] + 1e-6 * random.standard_normal((300, 64))
    assert recall(spark, list(range(6000)), vectors, 97) >= 0.95


def test_one_long_vector_does_not_blunt_the_codes(spark):
    random = np.random.default_rng(6)
    vectors = random.standard_normal((4000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[17] *= 1000
    assert recall(spark, list(range(4000)), vectors, 41) >= 0.93


def test_large_ids_and_components(spark):
    one = [0.5] * 8
    rows = [(2**53, one), (2**53 + 1, one), (2**53 + 2, one), (20, [1e200] + [0.0] * 7), (40, [0.1] * 8), (60, [1e-200] * 8), (60, [1e-200] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.nearest(df, 20, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [20, 40, 60]
    assert sorted(i for _, i, _ in got[40]) == sorted({20, 60, 2**53, 2**53 + 1, 2**53 + 2})
    assert sorted(got[40])[0] == (1, 20, 1e199) and [i for _, i, _ in sorted(got[40])[1:4]] == [2**53, 2**53 + 1, 2**53 + 2]


def test_every_code_within_the_radius_is_retrieved():
    random = np.random.default_rng(3)
    codes = random.integers(0, 2**63, (400, 4)).astype(np.uint64)
    flips = np.packbits(random.random((20, 256)) < 0.1, axis=1).view(np.uint64)
    asked = codes[:20] ^ flips
    for radius in (0, 9, 27, 60):
        who, rows = multi_index.MultiIndex(codes).within(asked, np.full(20, radius))
        apart = multi_index.distances(asked[:, None, :], codes[None, :, :])
        assert set(zip(who.tolist(), rows.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(apart <= radius))))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    ids = {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
    mixed = docs.toArrow().to_pylist()
    assert {r["doc_id"] for r in mixed} <= ids and all(r["n_chars"] == len(r["text"]) for r in mixed)
    assert not any(re.search(r"[A-Za-z0-9]@[a-z0-9-]+\.[a-z]", r["text"]) for r in mixed)
    final = corpus_pipeline.run(spark, SF)
    assert final.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == {r["doc_id"] for r in mixed}
    nothing = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql_counterpart(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = con.execute(oracles.SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = [tuple(plain(r[found.index(c)]) for c in columns) for r in cursor.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key) and got


def test_every_query_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if re.match(r"op\d+_", n))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
