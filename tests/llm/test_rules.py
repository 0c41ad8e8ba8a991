"""Personal data, weak supervision, language, curriculum and perspectives on small tables."""

import hashlib
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from offermatch.llm import curriculum, language, personal_data, perspectives, weak_supervision
from offermatch.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "a@b.c_d@e.f x", "999.1.1.1.2.3.4.5 1.2.3.4.5 0001.2.3.0255 1.2.3.99999999999999999999999999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1111, +4111111111111111 +1 (017) 555-7713.", "+1((((", "5 5 5 " * 3,
    "é😀 a.b@c.de é😀x@y.zz", "1" * 5000, "1 " * 5000, "a" * 50_000, "a.b@" * 3000, "+1" * 3000, "x.y@" * 500 + "x.y",
]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def base_spans(text):
    text = text or ""
    if len(text) == 50_000:  # the plain pattern takes quadratic time on it
        return []
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, SPANS string")
    found = personal_data.spans_of(df)
    assert found.columns == ["doc_id", "text", "SPANS", "spans_"]
    got = {r["doc_id"]: r for r in personal_data.digest(found, name="spans_").collect()}
    for i, text in enumerate(TEXTS * 2):
        want = base_spans(text)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), text and text[:60]
        assert got[i]["spans"] == line
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
    assert personal_data.spans_of(df.limit(0)).count() == 0


def test_checksums_and_context(spark):
    texts = ["IBAN: DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE89 3704 0044 0532 0130 01",
             "call 555-123-4567", "no context here at all, for forty characters 555-123-4567"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.spans_of(df)).collect()}
    assert spans == {0: "iban:6:33,iban:34:56", 1: "local_phone:5:17", 2: ""}


def test_redaction(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "mail a@b.cd, card 4111 1111 1111 1111."]], "text string")
    got = [r["text"] for r in personal_data.redacted(df).collect()]
    assert got[0] is None and got[1] == ""
    assert "mail [EMAIL], card [CARD]." in got
    assert not any(base_spans(t) for t in got)


def test_texts_of_many_matches(spark):
    """Numbers around the lengths of runs, and tens of thousands of matches in one text."""
    texts = ["é a@b.cd, 1.2.3.4 +1 (017) 555-7713;" * n for n in (1, 21, 22, 64, 65, 4096, 4097, 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, marked_spans string")
    begun = time.monotonic()
    got = {r["doc_id"]: r for r in personal_data.digest(personal_data.spans_of(df)).collect()}
    clean = {r["doc_id"]: r for r in personal_data.redacted(df).collect()}
    assert time.monotonic() - begun < 60
    for i, text in enumerate(texts):
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
        assert got[i]["spans"] == line
        assert clean[i]["marked_spans"] == "x"
        assert clean[i]["text"] == plainly_redacted(text)


def plainly_redacted(text):
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in base_spans(text)):
        out.append(text[at:max(at, start)] + (f"[{kind.upper()}]" if start >= at else ""))
        at = max(at, end)
    return "".join(out) + text[at:]


def features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered))


def test_weak_supervision(spark):
    clean = [" ".join(f"word{(i * 37 + j * 11) % 97}x{j}" for j in range(60)) + ".\nA second line stands here.\nAnd a third."
             for i in range(40)]
    junk = [" ".join(f"w{(i + j) % 50}{j}###" for j in range(60)) for i in range(8)]
    loops = ["the same eight words come again and again " * 8, "a b c d e f g h " * 2 + "i j", "x " * 30, None, "", " \x0b\n", "é ü"]
    texts = clean + junk + loops
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in weak_supervision.judged(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        f = features(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == f, t
        assert r["base_failed"] == (f[0] < 20 or 100 * f[4] > 30 * f[0])
        assert not (r["kept"] and r["base_failed"])
    assert all(got[i]["kept"] for i in range(40))
    assert not any(got[i]["kept"] for i in range(40, len(texts)))
    assert weak_supervision.judged(df.limit(0)).count() == 0
    model = weak_supervision.estimate(weak_supervision.votes(weak_supervision.features(df)))
    assert model.accuracies()["symbols"][1] == pytest.approx(1.0, abs=0.1)


def plain_em(rows, rounds):
    """EM over documents, one by one, with numpy; the bounds by searching the likeliest shares on a line."""
    w = weak_supervision
    rules = len(w.RULES)
    prior, good, bad = w.PRIOR, np.tile(w.ON_GOOD, (rules, 1)), np.tile(w.ON_BAD, (rules, 1))
    cast = np.array([[[v == k for k in (-1, 0, 1)] for v in row] for row in rows], float)  # document, rule, vote
    evidence = cast * [1, 0, 1]  # abstentions do not count

    def quality():
        odds = np.log(prior / (1 - prior)) + (evidence * (np.log(good) - np.log(bad))).sum(axis=(1, 2))
        return 1 / (1 + np.exp(-odds))

    for _ in range(rounds):
        p = quality()
        prior = min(0.99, max(0.01, p.mean()))
        good = (np.einsum("d,drk->rk", p, cast) + w.ON_GOOD) / (p.sum() + 1)
        bad = (np.einsum("d,drk->rk", 1 - p, cast) + w.ON_BAD) / ((1 - p).sum() + 1)
        for shares, low, high in ((good, 0.0, w.FALSE_ALARMS), (bad, w.HITS, 1 - w.FALSE_ALARMS)):
            held = np.clip(shares[:, 0], low, high)
            shares[:, 1:] *= ((1 - held) / (1 - shares[:, 0]))[:, None]
            shares[:, 0] = held
        for g, b in zip(good, bad):
            if g[2] < b[2]:
                n, m = p.sum() + 1, (1 - p).sum() + 1
                g[2] = b[2] = (n * g[2] + m * b[2]) / (n + m)
                g[1], b[1] = 1 - g[0] - g[2], 1 - b[0] - b[2]
    assert np.allclose(good.sum(axis=1), 1) and np.allclose(bad.sum(axis=1), 1)
    return quality()


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_equals_plain_em(spark, seed):
    rng = np.random.default_rng(seed)
    good = rng.random(300) < 0.7
    rows = [[int(rng.choice([-1, 0, 1], p=[0.05, 0.35, 0.6] if g else [0.5, 0.3, 0.2])) for _ in weak_supervision.RULES]
            for g in good]
    rows = [[*row[:4], -1, *row[5:]] if seed == 2 and i % 3 else row for i, row in enumerate(rows)]  # a rule always against
    columns = ", ".join(f"vote_{r} int" for r in weak_supervision.RULES)
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"doc_id long, {columns}")
    model = weak_supervision.estimate(df)
    for shares in (*model.on_good, *model.on_bad):
        assert sum(shares) == pytest.approx(1.0) and min(shares) > 0
    got = {r[0]: r[1] for r in df.select("doc_id", weak_supervision.posterior(model)).collect()}
    assert [got[i] for i in range(len(rows))] == pytest.approx(plain_em(rows, weak_supervision.ROUNDS), abs=1e-9)


def test_quality_of_odd_tables(spark):
    """A very long text, repeated rows, and columns with the names of counts and votes."""
    long = " ".join(f"word{i}" for i in range(200_000)) + "."
    texts = [long, "same text " * 12, "same text " * 12, None]
    df = spark.createDataFrame([(i // 2, t, 7, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, n_words int, vote_symbols string")
    got = weak_supervision.judged(df).collect()
    assert sorted(r["n_words"] for r in got) == [0, 24, 24, 200_000]
    assert {r["vote_symbols"] for r in got} <= {-1, 0, 1} and len(got) == 4
    assert all(r["base_failed"] == (r["n_words"] < 200_000) for r in got)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.explode(F.array(
        F.lit(None).cast("string"), F.lit(""), F.lit("12 !"), F.lit("x" * 100_000))).alias("text"),
        F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    got = language.identified(docs.unionAll(odd)).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] is None)[-3:] == ["und"] * 3
    assert language.identified(docs.limit(0)).count() == 0
    kept = language.accepted(docs.withColumn("LANG_PRED", F.lit(1)))
    assert kept.columns == [*docs.columns, "LANG_PRED"] and kept.count() >= 995


def test_no_word_is_cut_from_the_vocabulary(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i, n=4: "".join(letters[i // 26**k % 26] for k in range(n))
    rows = [(i, "aa", " ".join(f"a{word(i * 100 + j)}" for j in range(100))) for i in range(200)]
    rows += [(1000 + i, "zz", f"z{word(i // 4 % 20)}zu") for i in range(80)]
    rows += [(2000 + i, "яя", f"ж{'бвг'[i % 3]}ю") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = language.learn(df)
    got = {r["token"]: r["vec"] for r in learned.evidence.collect()}
    counted = {}
    teaching = {r["doc_id"] for r in df.where(~language.held_out()).collect()}
    for key, lang, text in rows:
        for w in re.findall(r"\w+", text) if key in teaching else ():
            marked = f"^{w}$"
            grams = [marked[i:i + n] for n in range(1, 6) for i in range(len(marked) - n + 1)]
            for kind, token in [(True, w), *((False, g) for g in grams)]:
                counted[kind, token, lang] = counted.get((kind, token, lang), 0) + 1
    totals = {}
    for (kind, _, lang), n in counted.items():
        totals[kind, lang] = totals.get((kind, lang), 0) + n
    model = language.Model.of([(*k, n) for k, n in counted.items()], totals)
    assert len(counted) > 80_000 and learned.languages == model.languages
    assert set(got) == {w for _, _, t in rows for w in t.split()}
    for w, vec in got.items():
        assert vec == pytest.approx(model.word(w).tolist(), abs=1e-9), w
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predicted(df, learned).collect()}
    assert sum(plain[key][0] == lang for key, lang, _ in rows) >= 0.99 * len(rows)
    assert all(plain[key][0] == lang for key, lang, _ in rows if lang == "яя")
    monkeypatch.setattr(language, "HELD_WORDS", 7)
    for r in language.predicted(df, learned).collect():
        assert r["lang_pred"] == plain[r["doc_id"]][0] and r["score"] == pytest.approx(plain[r["doc_id"]][1])


def test_every_labelled_document_teaches(spark):
    rare = [(40_000 + i, "zz", "zog zig zag") for i in range(40)]
    many = spark.range(40_000).select(
        "id", F.when(F.col("id") % 100 == 0, "aa").alias("lang"), F.lit("alpha beta").alias("text"))
    df = many.unionAll(spark.createDataFrame(rare, "id long, lang string, text string"))
    teaching = df.where(~language.held_out("id") & F.col("lang").isNotNull())
    learned = language.learn(df, "id")
    assert learned.languages == ["aa", "zz"]
    words = learned.evidence.where("token in ('alpha', 'zog')").collect()
    assert {r["token"]: r["total"] for r in words} == {"alpha": 40_000, "zog": 40}
    sums = {r["lang"]: r["count"] for r in teaching.groupBy("lang").count().collect()}
    least = language.SMOOTHING / (2 * sums["aa"] + 3 * sums["zz"])
    vec = {r["token"]: r["vec"] for r in words}
    assert math.exp(vec["zog"][0]) == pytest.approx(least)
    assert math.exp(vec["zog"][1]) == pytest.approx(1 / 3 + least)
    assert {r["lang_pred"] for r in language.predicted(df.where("lang = 'zz'"), learned).collect()} == {"zz"}
    bare = spark.createDataFrame([(1, None, "some text"), (2, None, "12 !"), (3, None, None)], "doc_id long, lang string, text string")
    assert [r["doc_id"] for r in language.accepted(bare).collect()] == [1]
    assert {r["lang_pred"] for r in language.identified(bare).collect()} == {"und"}


def test_backoff_is_word_first():
    model = language.Model.of(
        [(True, "the", "a", 9), (True, "der", "b", 9), (False, "^de", "b", 9), (False, "e", "a", 3), (False, "e", "b", 3),
         (False, "^th", "a", 9)],
        {(True, "a"): 9, (True, "b"): 9, (False, "a"): 12, (False, "b"): 12})
    assert model.word("the").argmax() == 0 and model.word("des").argmax() == 1 and model.word("thx").argmax() == 0
    assert model.word("zez")[0] == model.word("zez")[1]
    assert (model.word("zzz") == 0).all()


def test_curriculum(spark):
    rows = [(i, f"s{i % 4}" if i % 4 else None, "w " * (1 + i * 7 % 40)) for i in range(400)]
    rows += [(1000, "tiny", "one two"), (1001, "none", ""), (1002, "none", None), (None, "s1", "x y"), (3, "s3", "w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = curriculum.mixed(df).collect()
    assert len(got) == len(rows)
    again = curriculum.mixed(df.repartition(7)).collect()
    plain = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"], r["target"]) for r in rs)
    assert plain(got) == plain(again)
    total = sum(r["size"] for r in got)
    goals = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in goals) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for s, t in goals)
    source = {i: s for i, s, _ in rows}
    taken = {}
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] and len(r["times"]) == r["copies"]
        assert all(0 <= t <= 1 for t in r["times"])
        key = source[r["doc_id"]], r["target"]
        taken[key] = taken.get(key, 0) + r["taken"]
    assert all(abs(t - goal) <= 20 for (_, goal), t in taken.items())
    assert curriculum.mixed(df.limit(0)).count() == 0
    mixture = curriculum.mixture(df.withColumns({"Training_Times": F.lit(5), "row_key_b": F.lit(6), "time": F.lit(7)}))
    assert mixture.columns == ["doc_id", "source", "text", "Training_Times", "row_key_b", "time"]
    assert mixture.count() == sum(r["copies"] for r in got)


def test_every_copy_has_a_training_position(spark):
    rows = [(i, f"s{i % 3}", "w " * (1 + i * 7 % 40)) for i in range(300)] + [(None, "s1", "x y"), (3, "s0", "w w"), (3, "s0", "w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    times = {}
    for r in curriculum.mixed(df).collect():
        times.setdefault(r["doc_id"], []).extend(r["times"])
    got = curriculum.positions(df.repartition(5)).collect()
    assert sorted(r["position"] for r in got) == list(range(sum(map(len, times.values()))))
    in_order = [r["time"] for r in sorted(got, key=lambda r: r["position"])]
    assert in_order == sorted(in_order)
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append(r["time"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in times.items() if v}


def test_the_registered_curriculum_stands_in_training_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r["doc_id"]: min(r["times"], default=2) for r in curriculum.mixed(docs).collect()}
    got = [first[r["doc_id"]] for r in QUERIES["op7_curriculum"](spark, sf).collect()]
    assert got == sorted(got) and len(got) == len(first)
    assert QUERIES["curriculum_positions"](spark, sf).count() == sum(
        r["copies"] for r in curriculum.mixed(docs).collect())


def test_training_time_inverts_the_schedule(spark):
    df = spark.range(0, 11).select((F.col("id") / 10).alias("f")).select(
        *[curriculum.training_time(F.col("f"), F.lit(t)).alias(str(i)) for i, t in enumerate(curriculum.TILTS)], "f")
    for r in df.collect():
        for i, tilt in enumerate(curriculum.TILTS):
            t = r[str(i)]
            assert (1 - tilt) * t + tilt * t * t == pytest.approx(r["f"])


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 700, "ann", "end"),
            (1, 700, "ann", "end"), (2, 0, None, "who"), (None, 0, "cy", "alone"), (1, None, "dee <x>", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("target", F.lit(1))
    got = perspectives.rotated(df).collect()
    assert len(got) == 6 * 3 + 1
    by = {}
    for r in got:
        by.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "dee <x>"), (None, "cy")}
    for (_, speaker), parts in by.items():
        parts.sort(key=lambda r: r["start"])
        text = "".join(r["segment"] for r in parts)
        at = 0
        for r in parts:
            assert r["start"] == at and r["length"] == len(r["segment"]) and r["target"] == (r["role"] == speaker)
            at += r["length"]
            if r["target"]:
                assert text[r["mask_start"]:r["mask_end"]].endswith("<|im_end|>")
                assert text[:r["mask_start"]].endswith("<|im_start|>assistant\n")
            else:
                assert r["mask_start"] is None
    ann = "".join(r["segment"] for r in by[(1, "ann")])
    assert ann.startswith("<|im_start|>user name=dee x\nfirst<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n")
    assert ann.count("<|im_end|>") == 6 and "<|im_start|>user name=bob\n<|im_end|>" in ann
    assert perspectives.rotated(df.limit(0)).count() == 0


def test_hashes_of_words_are_computed_once_for_all_windows(spark):
    from offermatch.llm.weak_supervision import repeated_words

    text = " ".join("abcdefgh") + " z " + " ".join("abcdefgh")
    df = spark.createDataFrame([(text,), ("a b",)], "t string").select(repeated_words(F.split("t", " ")).alias("n"))
    assert df._jdf.queryExecution().analyzed().toString().count("xxhash64") <= 4
    assert [r.n for r in df.collect()] == [16, 0]
