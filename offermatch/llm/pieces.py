"""Splitting text into the pieces of a byte-level BPE tokenizer with a compiled finite-state machine.

The pre-tokenizer's pattern (contractions, optional space plus letters, digits or other signs, white
space that leaves its last character to the next piece) becomes a deterministic machine over
character classes.  Every character acts on the machine's states as a function; the functions that
chunks of text can act as form a finite monoid, which is compiled once.  A text is cut into chunks of
equal length, all chunks are run in lockstep to find their state maps, the maps compose in a parallel
prefix scan, and a second lockstep run with known entry states marks where pieces begin.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import numpy as np

# Character classes.  Letters that can follow an apostrophe in a contraction have their own.
LETTER, ONE, RV, E, EL, DIGIT, SPACE, WHITE, OTHER, APOSTROPHE, RESET = range(11)
CLASSES = 11
LETTERS = (LETTER, ONE, RV, E, EL)
# States: what the open piece looks like.
BEGIN, WORD, NUMBER, SIGNS, QUOTE, QUOTE_RV, QUOTE_EL, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE = range(11)
STATES = 11
HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before it

CHUNK = 512
BLOCK = 4_000_000  # characters worked on at a time; longer texts carry their open piece over


def _fresh(kind: int) -> int:
    """The state after the first character of a piece."""
    if kind in LETTERS:
        return WORD
    return {DIGIT: NUMBER, SPACE: ONE_SPACE, WHITE: ONE_WHITE, OTHER: SIGNS, APOSTROPHE: QUOTE,
            RESET: BEGIN}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and where pieces begin, for one character."""
    if kind == RESET:
        late = state in (QUOTE_RV, QUOTE_EL)
        return BEGIN, HERE | (BEFORE if late else 0)
    if state in (QUOTE_RV, QUOTE_EL):
        if (state, kind) in ((QUOTE_RV, E), (QUOTE_EL, EL)):
            return BEGIN, 0
        after, begins = _step(WORD, kind)  # only the apostrophe was a piece; a word began after it
        return after, begins | BEFORE
    if state == QUOTE and kind in (ONE, RV, EL):
        return {ONE: BEGIN, RV: QUOTE_RV, EL: QUOTE_EL}[kind], 0
    white = kind in (SPACE, WHITE)
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if white:
            return (RUN_SPACE if kind == SPACE else RUN_WHITE), 0
        if state in (ONE_WHITE, RUN_WHITE):
            return _fresh(kind), HERE | (BEFORE if state == RUN_WHITE else 0)
        joined = SIGNS if kind == APOSTROPHE else _fresh(kind)  # the space leads the piece
        return joined, (BEFORE if state == RUN_SPACE else 0)
    grows = (state == WORD and kind in LETTERS) or (state == NUMBER and kind == DIGIT) or (
        state in (SIGNS, QUOTE) and kind in (OTHER, APOSTROPHE))
    if grows:
        return (SIGNS if state == QUOTE else state), 0
    return _fresh(kind), HERE


def _classes(pre_tokenizer: Any) -> np.ndarray:
    """The class of every code point; letters and digits as the tokenizer's own tables know them."""
    import regex

    points = [chr(c) if not 0xD800 <= c <= 0xDFFF else "\x00" for c in range(0x110000)]
    line = "".join(points)
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", WHITE)):
        for found in regex.finditer(pattern, line):
            table[found.start():found.end()] = kind
    for lead, kind in (("a", LETTER), ("1", DIGIT)):
        asked = np.flatnonzero(table == kind).tolist()
        parts = pre_tokenizer.pre_tokenize_str("".join(f"{lead}{chr(c)}\n" for c in asked))
        whole = {begin // 3 for _, (begin, end) in parts if end - begin == 2 and begin % 3 == 0}
        table[[c for i, c in enumerate(asked) if i not in whole]] = OTHER  # newer than its tables
    for letters, kind in (("stmd", ONE), ("rv", RV), ("e", E), ("l", EL), (" ", SPACE), ("'", APOSTROPHE)):
        table[[ord(c) for c in letters]] = kind
    return table


class Splitter:
    """Pieces of texts; ``special`` strings are pieces of their own and end what stands before them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.special = sorted(special_strings(path), key=len, reverse=True)
        self.classes = _classes(Tokenizer.from_file(path).pre_tokenizer)
        table = [[_step(s, k) for k in range(CLASSES)] for s in range(STATES)]
        self.next = np.array([[t[0] for t in row] for row in table], np.intp).ravel()
        self.out = np.array([[t[1] for t in row] for row in table], np.uint8).ravel()
        self._compile()

    def _compile(self) -> None:
        """The monoid of state maps: its elements, and its table of compositions."""
        step = self.next.reshape(STATES, CLASSES)
        maps, seen = [tuple(range(STATES))], {tuple(range(STATES)): 0}
        grown = []
        for m in maps:  # the list grows while it is read
            row = []
            for k in range(CLASSES):
                then = tuple(int(step[s, k]) for s in m)
                if then not in seen:
                    seen[then] = len(maps)
                    maps.append(then)
                row.append(seen[then])
            grown.append(row)
        self.maps = np.array(maps, np.intp)
        self.grow = np.array(grown, np.intp).ravel()
        composed = self.maps[:, self.maps]  # [later, earlier, state]
        self.compose = np.array([[seen[tuple(int(v) for v in composed[b, a])] for b in range(len(maps))]
                                 for a in range(len(maps))], np.intp)

    def begins(self, text: str) -> np.ndarray:
        """Sorted offsets in ``text`` where pieces begin."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._begins(self.classes[points])

    def _begins(self, kinds: np.ndarray) -> np.ndarray:
        size = len(kinds)
        chunks = size // CHUNK + 1  # the padding ends the text
        cells = np.full((CHUNK, chunks), RESET, np.uint8)
        padded = np.full(chunks * CHUNK, RESET, np.uint8)
        padded[:size] = kinds
        cells[:] = padded.reshape(chunks, CHUNK).T
        maps = np.zeros(chunks, np.intp)
        for row in cells:
            maps = self.grow[maps * CLASSES + row]
        span = 1
        while span < chunks:  # prefix scan: maps[i] becomes the map of all chunks up to i
            maps[span:] = self.compose[maps[:-span], maps[span:]]
            span *= 2
        states = np.empty(chunks, np.intp)
        states[0] = BEGIN
        states[1:] = self.maps[maps[:-1], BEGIN]
        marks = np.empty((CHUNK, chunks), np.uint8)
        for i, row in enumerate(cells):
            at = states * CLASSES + row
            marks[i] = self.out[at]
            states = self.next[at]
        flat = np.ascontiguousarray(marks.T).ravel()
        starts = (flat & HERE).astype(bool)
        starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
        return np.flatnonzero(starts[:size])

    def _plain(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text without special strings, in lists."""
        done = 0
        window = BLOCK
        while done < len(text):
            part = text[done:done + window]
            last = done + window >= len(text)
            at = self.begins(part).tolist()
            ends = at[1:] + [len(part)]
            if not last:
                if len(at) < 3:  # an open piece fills the window: look further
                    window *= 2
                    continue
                ends = ends[:-2]  # what follows can still change the last two
            yield [part[a:b] for a, b in zip(at, ends)]
            done += ends[-1]
            window = BLOCK

    def pieces(self, text: str) -> Iterator[list[str]]:
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                yield [part]
            else:
                yield from self._plain(part)

    def cut(self, text: str) -> list[str]:
        """Plain stretches and, at odd places, special strings."""
        if not any(s in text for s in self.special):
            return [text]
        import re

        return re.split("(" + "|".join(map(re.escape, self.special)) + ")", text)

    def batch(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """(pieces in each text, all their pieces) for consecutive runs of the texts."""
        joined: list[str] = []
        room = 0
        for text in texts:
            long = len(text) > BLOCK or any(s in text for s in self.special)
            if joined and (long or room + len(text) > BLOCK):
                yield self._joined(joined)
                joined, room = [], 0
            if long:
                found = [p for part in self.pieces(text) for p in part]
                yield [len(found)], found
            else:
                joined.append(text)
                room += len(text) + 1
        if joined:
            yield self._joined(joined)

    def _joined(self, texts: list[str]) -> tuple[list[int], list[str]]:
        """Short texts run together, with a reset between them."""
        line = "\n".join(texts)
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes[points]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        marks = np.cumsum(sizes + 1)[:-1] - 1
        kinds[marks] = RESET
        at = self._begins(kinds)
        stops = np.append(at, len(line))[1:]
        separator = np.zeros(len(line) + 1, bool)
        separator[marks] = True
        keep = ~separator[at]
        at, stops = at[keep], stops[keep]
        first = np.searchsorted(at, np.append(0, marks + 1))
        counts = np.diff(np.append(first, len(at)))
        return counts.tolist(), [line[a:b] for a, b in zip(at.tolist(), stops.tolist())]


def special_strings(path: str) -> list[str]:
    """Added tokens of a tokenizers file, which are found inside texts too."""
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


class _Known(dict):
    def __missing__(self, piece: str) -> None:
        return None


class Memo:
    """Values of pieces, worked out once while they are remembered; forgetting changes no result.

    Two generations, each begun anew beyond ``room`` entries or ``letters`` letters in them: what the older one
    still answers moves on.
    """

    def __init__(self, fixed: dict[str, Any], make: Callable[[list[str]], list], room: int = 400_000,
                 letters: int = 16_000_000):
        self.fixed, self.make, self.room, self.letters = fixed, make, room, letters
        self.new, self.old, self.held = _Known(fixed), {}, 0

    def values(self, pieces: list[str]) -> list:
        if len(self.new) > self.room or self.held > self.letters:
            self.new, self.old, self.held = _Known(self.fixed), self.new, 0
        new, old = self.new, self.old
        # All look-ups in one call of the interpreter; it gives a bare value for a single piece.
        found = list(itemgetter(*pieces)(new)) if len(pieces) > 1 else [new[p] for p in pieces]
        gaps = [i for i, value in enumerate(found) if value is None]
        if gaps:
            missing = {piece: old.get(piece) for piece in map(pieces.__getitem__, gaps)}
            unknown = [piece for piece, value in missing.items() if value is None]
            missing.update(zip(unknown, self.make(unknown)))
            new.update(missing)
            self.held += sum(map(len, missing))
            for i in gaps:
                found[i] = missing[pieces[i]]
        return found
