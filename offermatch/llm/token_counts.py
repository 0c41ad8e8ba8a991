"""Token counts of texts by a byte-level BPE tokenizer compiled to finite-state transducers (operator 1).

Two machines are chained.  The splitting machine (``pieces``) finds pieces of text: maps of chunks
compose in a parallel prefix scan.  Inside a piece the merge rules become a deterministic transducer
over bytes whose transitions carry the change in the number of tokens that a byte causes.  Its states
hold what can still matter: the longest suffix that a longer token may continue, and the last token
and relative token count at each place of that suffix.  States are compiled when first reached.

Why the counts are exact: a token sequence is what the merges produce if and only if each neighbouring
pair is what the merges make of that pair alone, and each prefix of a piece has one such sequence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offermatch.llm.common import free_name, per_process
from offermatch.llm.pieces import Memo, Splitter

START = -1
MAX_STATES = 300_000  # of the compiled transducer, then it is compiled anew; results stay the same


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeRules:
    """Tokens numbered in merge order: 0-255 single bytes, then one for each rule."""

    def __init__(self, path: str):
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.texts = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.texts)}
        self.joined: dict[tuple[int, int], int] = {}
        for rule in model["merges"]:
            left, right = (rule.split(" ") if isinstance(rule, str) else rule)
            a, b = (bytes(letters[c] for c in side) for side in (left, right))
            self.joined[number[a], number[b]] = number[a + b] = len(self.texts)
            self.texts.append(a + b)
        self.number = number
        self.apart: dict[tuple[int, int], bool] = {}

    def encode(self, piece: bytes) -> list[int]:
        """The merges applied one by one, earliest rule first, leftmost place first."""
        tokens = list(piece)
        while len(tokens) > 1:
            found = [(self.joined.get(pair, len(self.texts)), i) for i, pair in enumerate(zip(tokens, tokens[1:]))]
            rule, i = min(found)
            if rule == len(self.texts):
                break
            tokens[i:i + 2] = [rule]
        return tokens

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges make just these two tokens of the two tokens' bytes."""
        pair = (left, right)
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= 2_000_000:
                self.apart.clear()
            known = self.apart[pair] = self.encode(self.texts[left] + self.texts[right]) == [left, right]
        return known


class Transducer:
    """Bytes of a piece in, number of tokens out."""

    def __init__(self, rules: MergeRules):
        self.rules = rules
        # Tokens that the merges do not make of their own bytes never appear.
        self.tokens = {t: n for t, n in rules.number.items() if len(t) < 3 or rules.encode(t) == [n]}
        self.open = {t[:i] for t in self.tokens for i in range(1, len(t))} | {b""}
        self.longest = max(map(len, self.tokens))
        self.clear()

    def clear(self) -> None:
        first = (b"", (START,), (0,))
        self.states = [first]
        self.known = {first: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, last, counts = self.states[state]
        suffix += bytes([byte])
        size = len(suffix)
        for begin in range(size):  # the longest token first; exactly one fits
            token = self.tokens.get(suffix[begin:])
            if token is not None and (last[begin] == START or self.rules.stay_apart(last[begin], token)):
                gain = counts[begin] + 1
                break
        else:
            raise ValueError("the merge rules leave a byte without a token")
        last += (token,)
        counts = tuple(c - gain for c in counts) + (0,)
        keep = next(i for i in range(size + 1) if suffix[i:] in self.open)
        # Places where no longer token can begin never count again; leaving them out merges states.
        live = [suffix[i:] in self.open for i in range(keep, size + 1)]
        then = (suffix[keep:], tuple(t if on else None for on, t in zip(live, last[keep:])),
                tuple(c if on else 0 for on, c in zip(live, counts[keep:])))
        number = self.known.get(then)
        if number is None:
            number = self.known[then] = len(self.states)
            self.states.append(then)
            self.moves.append({})
        self.moves[state][byte] = number, gain
        return number, gain

    def count(self, piece: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.clear()
        state = total = 0
        moves = self.moves
        for byte in piece:
            move = moves[state].get(byte)
            if move is None:
                move = self._compile(state, byte)
            state, gain = move
            total += gain
        return total


class TokenCounter:
    """Token counts of texts; equal pieces are counted once while the memo holds them."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        self.transducer = Transducer(MergeRules(path))
        self.memo = Memo({s: 1 for s in self.splitter.special}, self._count)

    def _count(self, pieces: list[str]) -> list[int]:
        return [self.transducer.count(p.encode("utf-8", "surrogatepass")) for p in pieces]

    def counts(self, texts: list[str]) -> list[int]:
        found: list[int] = []
        for sizes, pieces in self.splitter.batch(texts):
            numbers = self.memo.values(pieces)
            at = 0
            for size in sizes:
                found.append(sum(numbers[at:at + size]))
                at += size
        return found


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024,
                 names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit")) -> DataFrame:
    """All columns of ``docs`` plus UTF-8 bytes, tokens and whether there are more than ``limit``.

    A null text counts as empty (0, 0, false); an empty table gives no rows; every row is kept, also
    repeated ones.  Columns whose names clash with the new ones (in any case) stay, and the new column
    gets underscores.  One narrow pass: no shuffle, nothing on the driver, memory bound by one Arrow
    batch and the memos, so a lost executor costs its running tasks only.
    """
    import pyarrow as pa

    source = docs.withColumn(free_name(docs, "counted_text"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    body = source.columns[-1]
    bytes_name, tokens_name, over_name = (free_name(docs, n) for n in names)
    inner = free_name(source, "counted_tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("token counter", tokenizer), lambda: TokenCounter(tokenizer))
        for batch in batches:
            place = batch.schema.get_field_index(body)
            numbers = pa.array(counter.counts(batch.column(place).to_pylist()), pa.int64())
            kept = [c for i, c in enumerate(batch.columns) if i != place]
            fields = [f for i, f in enumerate(batch.schema) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, numbers], schema=pa.schema([*fields, pa.field(inner, pa.int64())]))

    size = free_name(source, "counted_bytes")
    slim = source.withColumn(size, F.octet_length(body).cast("long"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name != body)
    done = slim.mapInArrow(count, schema + f"`{inner}` long")
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(size).alias(bytes_name),
                       F.col(inner).alias(tokens_name), (F.col(inner) > limit).alias(over_name))
