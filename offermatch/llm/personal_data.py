"""Personal data in texts: patterns propose, checksums confirm, context words adjust (operator 9).

Everything is a Column expression.  A pattern's matches and the gaps between them are taken as two
arrays; prefix sums of their lengths give the spans.  Patterns use possessive loops and look back to where a run begins,
so that they take linear time on any text and still find what the plain patterns find.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch.llm.common import free_name

KEEP = 0.6  # score from which a span of an added kind counts
BEFORE, AFTER = 40, 20  # characters of context
CONTEXT_GAIN = 0.3

LOCAL = "[A-Za-z0-9._%+-]"
RUN = 64  # items of an array that are handled by appending or cutting one after another
LEVELS = 3  # runs, runs of runs, ...: work on n items grows as n * RUN + (n / RUN ** 2) ** 2


class Kind(NamedTuple):
    name: str
    pattern: str
    score: float  # of a confirmed match without context
    words: str  # context words, as a pattern over lower case
    base: bool


# The contract's patterns, in its order, then the added kinds.
KINDS = [
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
         r"e-?mail|mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|address|host|server|client", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"card|visa|credit|debit|payment|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"phone|tel|call|mobile|fax|anruf|appel", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
         r"(?![A-Za-z0-9])", 0.7,
         r"iban|bank|account|konto|compte|cuenta", False),
    Kind("local_phone", r"(?<![0-9+.-])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", 0.4,
         r"phone|tel|call|mobile|fax|anruf|appel", False),
]
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(number, -at, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(at % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: its letters count as two digits, its head goes last."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, letter: Column) -> Column:
        digit = letter.between("0", "9")
        value = F.when(digit, F.ascii(letter) - 48).otherwise(F.ascii(letter) - 55)
        return F.when(digit, rest * 10 + value).otherwise(rest * 100 + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda part: F.coalesce(
            F.regexp_replace(part, "^0+(?=[0-9])", "").try_cast("decimal(38,0)") <= 255, F.lit(False))
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(digits(match)).between(16, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        lengths = F.create_map(*[F.lit(v) for item in IBAN_LENGTHS.items() for v in item])
        right = F.coalesce(F.try_element_at(lengths, F.substring(plain, 1, 2)) == F.length(plain), F.lit(False))
        return right & mod97(plain)
    return F.lit(True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs(items: Column, length: int) -> Column:
    """The array, cut into arrays of ``length`` items, the last one shorter; one empty array if it is empty."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / length).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * length + 1, F.lit(length)))


def before(values: Column, combine: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """For each place of an array of longs, what ``combine`` makes of zero and all values before it.

    Appending copies an array, so only short runs are built that way; what each run starts from is found
    from the runs' totals, in the same manner.
    """
    zero = F.lit(0).cast("long")
    if levels == 1:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, start, lambda s, v: F.struct(
            combine(s["at"], v).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])

    def joined_up(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, combine))
        return F.flatten(F.zip_with(parts, bound(totals, lambda t: before(t, combine, levels - 1)), lambda part, base: (
            F.transform(before(part, combine, 1), lambda at: combine(base, at)))))

    return bound(runs(values, RUN), joined_up)


def pieces(text: Column, cuts: Column, levels: int = LEVELS) -> Column:
    """The parts of ``text`` at ``cuts``, an ascending array of (start, end) that do not overlap.

    Finding a place in a text means counting from its beginning, so a run of cuts gets its own part of the
    text first and is cut out of that.
    """
    def part(body: Column, start: Column, end: Column) -> Column:
        return F.substring(body, (start + 1).cast("int"), (end - start).cast("int"))

    if levels == 1:
        return F.transform(cuts, lambda c: part(text, c["start"], c["end"]))

    def cut_run(run: Column) -> Column:
        first = F.get(run, F.lit(0))["start"]
        moved = F.transform(run, lambda c: F.struct((c["start"] - first).alias("start"), (c["end"] - first).alias("end")))
        return bound(F.struct(part(text, first, F.element_at(run, -1)["end"]).alias("body"), moved.alias("cuts")),
                     lambda own: pieces(own["body"], own["cuts"], levels - 1))

    return F.flatten(F.transform(runs(cuts, RUN ** (levels - 1)), cut_run))


def spans(text: Column, kind: Kind) -> Column:
    """Confirmed matches of a kind: an array of (kind, start, end, score), in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    def weigh(pair: Column, at: Column, after: Column) -> Column:
        near = F.lower(F.concat(F.right(pair["gap"], F.lit(BEFORE)), F.lit(" "),
                                F.left(F.coalesce(after, F.lit("")), F.lit(AFTER)))).rlike(kind.words)
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0))
        begin = at + F.length(pair["gap"])
        return F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"),
                        (begin + F.length(pair["match"])).alias("end"), score.alias("score"),
                        confirmed(kind.name, pair["match"]).alias("ok"))

    def all_spans(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: (F.length(p["gap"]) + F.length(p["match"])).cast("long"))
        places = before(lengths, lambda total, n: total + n)
        placed = F.zip_with(pairs, places, lambda pair, at: F.struct(pair.alias("pair"), at.alias("at")))
        weighed = F.zip_with(placed, F.slice(gaps, F.lit(2), F.size(pairs)),
                             lambda p, after: weigh(p["pair"], p["at"], after))
        return F.filter(weighed, lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= KEEP)))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)),
                       lambda match, gap: F.struct(match.alias("match"), gap.alias("gap")))
    kept = F.transform(bound(pairs, all_spans), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                s["end"].alias("end"), s["score"].alias("score")))
    return F.when(text.rlike(kind.pattern), kept).otherwise(
        F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def spans_of(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """All columns of ``docs`` plus an array of spans, by kind as listed, then by start.

    A null or empty text has none.  Base kinds keep every confirmed match whatever its context; added
    kinds need a score.  Rows are kept as they are, also repeated ones; if a column has the new name, the
    new one gets underscores.  One narrow pass inside the JVM.
    """
    source = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(free_name(docs, name), F.concat(*[spans(source, kind) for kind in KINDS]))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, doc_id: str = "doc_id", name: str = "spans") -> DataFrame:
    """doc_id, the counts of base kinds, a hash of the base spans, and all spans as a string."""
    column = F.col(f"`{name}`")
    base = [kind.name for kind in KINDS if kind.base]

    def count(kind: str) -> Column:
        return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter(column, lambda s: s["kind"].isin(base))
    return found.select(F.col(f"`{doc_id}`"), *map(count, base), F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"),
                        joined(column).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with every span of ``spans_of`` replaced by its kind in brackets.

    Overlapping spans become one mark, that of the first.  A null text stays null; other columns keep
    their names and values, whatever they are called.
    """
    body, marks = F.col(f"`{text}`"), "marked_spans"
    found = spans_of(docs, text, marks)
    column = F.col(f"`{found.columns[-1]}`")
    order = F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                s["kind"].alias("kind"))))

    def marked(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda s: s["end"])
        return bound(before(ends, lambda a, b: F.greatest(a, b)), lambda at: filled(ordered, at))

    def filled(ordered: Column, at: Column) -> Column:
        plain = F.zip_with(ordered, at, lambda s, a: F.struct(a.alias("start"), F.greatest(a, s["start"]).alias("end")))
        tail = F.struct(F.array_max(F.transform(ordered, lambda s: s["end"])).alias("start"),
                        F.length(body).cast("long").alias("end"))
        labels = F.zip_with(ordered, at, lambda s, a: F.when(
            s["start"] >= a, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        parts = bound(F.concat(plain, F.array(tail)), lambda cuts: pieces(body, cuts))
        return F.array_join(F.zip_with(parts, labels, lambda t, mark: F.concat(t, F.coalesce(mark, F.lit("")))), "")

    clean = F.when(F.size(column) > 0, bound(order, marked)).otherwise(body)
    return found.select(*[(clean.alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns])
