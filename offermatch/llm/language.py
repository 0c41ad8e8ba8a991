"""Language of texts, words first, then character n-grams (operator 10).

A known word scores by its log frequency in each language.  An unseen word backs off to its character
n-grams, the longest that are known in training, from five characters down to one.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch.llm.common import free_name, per_process, stored

LETTERS = r"\p{L}+"
LONGEST = 5
HELD_WORDS = 50_000  # the most frequent words, whose evidence every task holds; that of the others is joined
SMOOTHING = 0.5  # of one occurrence among those in all languages, so that the size of a language favours none
UNDETERMINED = "und"
DOUBT = 12  # words after which more of the same no longer raise the score


class Model:
    """Log frequencies by language: a row of ``table`` for each known word and n-gram.

    The plain definition, for small tables; ``learn`` gives the same log frequencies as a table.
    """

    def __init__(self, languages: list[str], words: dict[str, int], grams: dict[str, int], table: np.ndarray):
        self.languages, self.words, self.grams, self.table = languages, words, grams, table

    @classmethod
    def of(cls, rows: list[tuple[bool, str, str, int]], totals: dict[tuple[bool, str], int]) -> Model:
        """From (is a word, token, language, count) and the counts of all tokens by kind and language."""
        languages = sorted({lang for _, lang in totals})
        place = {lang: i for i, lang in enumerate(languages)}
        index: dict[bool, dict[str, int]] = {True: {}, False: {}}
        for word, token, _, _ in rows:
            index[word].setdefault(token, len(index[True]) + len(index[False]))
        counts = np.zeros((len(index[True]) + len(index[False]), len(languages)))
        kinds = np.zeros(len(counts), bool)
        for word, token, lang, count in rows:
            counts[index[word][token], place[lang]] += count
            kinds[index[word][token]] = word
        table = np.empty_like(counts)
        for kind in (True, False):
            sums = np.array([totals.get((kind, lang), 0) for lang in languages])
            table[kinds == kind] = np.log(counts[kinds == kind] / np.maximum(sums, 1) + SMOOTHING / max(sums.sum(), 1))
        return cls(languages, index[True], index[False], table)

    def word(self, word: str) -> np.ndarray:
        """Log frequency of one word in each language, backing off where it is unseen."""
        row = self.words.get(word)
        if row is not None:
            return self.table[row]
        marked = f"^{word}$"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            known = [self.grams[g] for g in (marked[i:i + n] for i in range(len(marked) - n + 1)) if g in self.grams]
            if known:
                return self.table[known].mean(axis=0)
        return np.zeros(len(self.languages))


def held_out(doc_id: str = "doc_id") -> Any:
    """Documents whose CRC-32 of the id leaves 2 when divided by 4; not those without an id."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Learned(NamedTuple):
    """What the labelled documents teach about the words of all documents."""

    languages: list[str]
    evidence: DataFrame | None  # token, total (occurrences in all documents), vec (log frequencies by language)


def counts(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """lang, token, n: the words of all texts, counted by ``lang``, which is null for those that teach nothing."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, held = regex.compile(LETTERS).findall, Held()
        for batch in batches:
            for name, words in zip(batch.column(0), batch.column(1)):
                if words.is_valid:
                    held.by[name.as_py()].update(find(words.as_py().lower()))
            yield from held.full()
        yield from held.all()

    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(work, Held.SCHEMA).groupBy("lang", "token").agg(
        F.sum("n").alias("n"))


class Held:
    """Counts by language of a task, given on when they are many; the sums of what is given on are whole."""

    SCHEMA = "lang string, token string, n long"
    MANY = 200_000

    def __init__(self) -> None:
        self.by: defaultdict[str | None, Counter] = defaultdict(Counter)

    def full(self) -> Iterator[Any]:
        if sum(map(len, self.by.values())) > self.MANY:
            yield from self.all()

    def all(self) -> Iterator[Any]:
        import pyarrow as pa

        kinds = pa.schema([("lang", pa.string()), ("token", pa.string()), ("n", pa.int64())])
        for lang, found in self.by.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.string()),
                pa.array(found.values(), pa.int64())], schema=kinds)
        self.by.clear()


def grams_of(word: str) -> Iterator[str]:
    marked = f"^{word}$"
    return (marked[i:i + n] for n in range(1, min(LONGEST, len(marked)) + 1) for i in range(len(marked) - n + 1))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, token, n: the character n-grams of words that are given as lang, token, n."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for name, word, times in zip(*(column.to_pylist() for column in batch.columns)):
                found = held.by[name]
                for gram in grams_of(word):
                    found[gram] += times
            yield from held.full()
        yield from held.all()

    return words.select("lang", "token", "n").mapInArrow(work, Held.SCHEMA).groupBy("lang", "token").agg(
        F.sum("n").alias("n"))


def word_grams(words: DataFrame) -> DataFrame:
    """id, gram, times: the distinct character n-grams of words that are given as id and token."""
    import pyarrow as pa

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                ids, grams, times = [], [], []
                for key, word in zip(*(column.to_pylist() for column in batch.slice(at, 1_000).columns)):
                    found = Counter(grams_of(word))
                    ids += [key] * len(found)
                    grams += found.keys()
                    times += found.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(grams, pa.string()), pa.array(times, pa.int64())],
                    names=["id", "gram", "times"])

    return words.select("id", "token").mapInArrow(work, "id long, gram string, times long")


def by_language(counted: DataFrame, languages: list[str], name: str) -> tuple[DataFrame, Column]:
    """token, total, c (counts by language) of each token; log frequencies by language as a Column over it."""
    wide = stored(counted.groupBy("token").agg(F.sum("n").alias("total"), F.array(*[
        F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)) for lang in languages]).alias("c")), name)
    found = wide.agg(*[F.sum(F.col("c")[i]) for i in range(len(languages))]).first()
    sums = [n or 0 for n in found]
    least = SMOOTHING / max(sum(sums), 1)
    return wide, F.array(*[F.log(F.col("c")[i] / max(n, 1) + least) for i, n in enumerate(sums)])


def taught() -> Column:
    return F.exists("c", lambda n: n > 0)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Learned:
    """Evidence for every word of ``docs``, from the text and lang of documents that are not held out.

    All of these count, with all their words and n-grams; rows without id, text or lang teach nothing.  The log
    frequencies of all words, as in ``Model``, are a table; nothing of its size comes to the driver or to a task.
    """
    teaches = F.col(f"`{doc_id}`").isNotNull() & ~held_out(doc_id)
    words = stored(counts(docs, F.when(teaches, F.col(f"`{lang}`").cast("string")), F.col(f"`{text}`")), "words")
    labelled = words.where(F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return Learned([], None)
    known, word_logs = by_language(words, languages, "known")
    grams, gram_logs = by_language(gram_counts(labelled), languages, "grams")
    unseen = stored(known.where(~taught()).select("token", "total", F.monotonically_increasing_id().alias("id")), "unseen")
    found = word_grams(unseen).join(grams.select(F.col("token").alias("gram"), gram_logs.alias("v")), "gram")
    means = found.groupBy("id", F.length("gram").alias("size")).agg(F.array(*[
        F.sum(F.col("v")[i] * F.col("times")) / F.sum("times") for i in range(len(languages))]).alias("v"))
    longest = means.groupBy("id").agg(F.max_by("v", "size").alias("vec"))
    nothing = F.array(*[F.lit(0.0)] * len(languages))
    backed = unseen.join(longest, "id", "left").select("token", "total", F.coalesce("vec", nothing).alias("vec"))
    return Learned(languages, stored(
        known.where(taught()).select("token", "total", word_logs.alias("vec")).unionAll(backed), "evidence"))


def predicted(docs: DataFrame, learned: Learned, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, or those to keep, plus lang_pred and score (0 to 1), from the text alone.

    ``und`` with score 0 where the text is null or has no letter, or where no language is known;
    ties go to the first language in code point order.  The score is the winner's posterior probability,
    with the words' mean evidence counted a dozen times at most, so that it stays short of 1 where they disagree.
    Rows stay as they are, also repeated ones; columns with clashing names stay and the new ones get
    underscores.  Each task holds the evidence of the most frequent words; for the others, the rows are
    joined with it.
    """
    import pyarrow as pa

    kept = docs.columns if keep is None else keep
    lang_name, score_name = free_name(docs, "lang_pred"), free_name(docs, "score")
    columns = [F.col(f"`{c}`") for c in kept]
    size = len(learned.languages)
    if not size:
        return docs.select(*columns, F.lit(UNDETERMINED).alias(lang_name), F.lit(0.0).alias(score_name))
    held = learned.evidence.orderBy(F.desc("total"), "token").limit(HELD_WORDS).select("token", "vec").toArrow()
    rows = held.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, size)
    version = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((held.column("token").to_pylist(), rows))
    row, part, words, rare = (free_name(docs, n) for n in ("row_number", "row_part", "row_words", "row_rare"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(LETTERS).findall
        index, table = per_process(("language evidence",), lambda: (
            {token: i for i, token in enumerate(shared.value[0])}, shared.value[1]), version)
        for batch in batches:
            sums, numbers, others = [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                found = find((value.as_py() or "").lower())
                at = list(map(index.get, found))
                others.append([w for w, i in zip(found, at) if i is None] if None in at else [])
                numbers.append(len(found))
                sums.append(table[[i for i in at if i is not None] if others[-1] else at].sum(axis=0) if found else np.zeros(size))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sums, pa.list_(pa.float64())),
                 pa.array(numbers, pa.int64()), pa.array(others, pa.list_(pa.string()))],
                schema=pa.schema([*(batch.schema.field(c) for c in kept), pa.field(part, pa.list_(pa.float64())),
                                  pa.field(words, pa.int64()), pa.field(rare, pa.list_(pa.string()))]))

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema)
    parts = stored(docs.mapInArrow(work, f"{schema}`{part}` array<double>, `{words}` long, `{rare}` array<string>").withColumn(
        row, F.monotonically_increasing_id()), "parts")
    pairs = parts.select(F.col(row).alias("row"), F.explode(rare).alias("token")).join(learned.evidence, "token")
    rest = pairs.groupBy("row").agg(F.array(*[F.sum(F.col("vec")[i]) for i in range(size)]).alias("rest"))
    whole = parts.join(rest.select(F.col("row").alias(row), F.col("rest").alias(rare + "_")), row, "left")
    total = F.when(F.col(rare + "_").isNull(), F.col(part)).otherwise(
        F.zip_with(part, rare + "_", lambda a, b: a + b))
    share = F.least(F.col(words), F.lit(DOUBT)) / F.col(words)
    best = F.array_max(part)
    names = F.array(*map(F.lit, learned.languages))
    any_word = F.col(words) > 0
    return whole.withColumn(part, F.when(any_word, F.transform(total, lambda x: x * share))).select(
        *columns,
        F.when(any_word, F.element_at(names, F.array_position(part, best).cast("int"))).otherwise(UNDETERMINED).alias(lang_name),
        F.when(any_word, 1 / F.aggregate(part, F.lit(0.0), lambda a, x: a + F.exp(x - best))).otherwise(0.0).alias(score_name))


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model learned from the others' labels."""
    learned = learn(docs, doc_id, text, lang)
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return predicted(slim, learned, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.3, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """The rows whose language is determined with at least the score ``least``.

    Where no label teaches a language, those whose text has a letter.
    """
    learned = learn(docs, doc_id, text, lang)
    if not learned.languages:
        return docs.where(F.regexp_like(F.col(f"`{text}`"), F.lit(LETTERS)))
    judged = predicted(docs, learned, text)
    lang_name, score_name = judged.columns[-2:]
    return judged.where((F.col(lang_name) != UNDETERMINED) & (F.col(score_name) >= least)).drop(lang_name, score_name)
