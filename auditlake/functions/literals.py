"""Texts that a pattern cannot match without, and looking for thousands of texts in one pass."""

from __future__ import annotations

import re
from collections import Counter
from re import _constants as op  # the parser of regular expressions is Python's own
from re import _parser

import numpy as np

#: Signs that match an ASCII letter when case is ignored, besides its own two forms.
FOLDED = str.maketrans({"ſ": "s", "K": "k", "İ": "i", "ı": "i"})
LEAST = 3


def folded(text: str) -> str:
    """A text in which ASCII letters that a pattern matches in any case are small."""
    if not text.isascii():
        for sign, plain in FOLDED.items():  # some times faster than ``translate``
            text = text.replace(chr(sign), plain)
    return text.lower()


def _runs(items, flush) -> list[set[str]]:
    """Sets of texts of which one at least must occur, for each item of a sequence that has such."""
    out, run = [], []

    def end():
        if run:
            out.append({"".join(run)})
            run.clear()

    for kind, value in items:
        if kind is op.LITERAL and value < 128:
            run.append(chr(value).lower())
        elif kind is op.SUBPATTERN and not value[2]:  # without flags that are turned off
            inner = list(value[3])
            if all(k is op.LITERAL and v < 128 for k, v in inner):
                run += [chr(v).lower() for _, v in inner]
            else:
                end()
                out += _runs(inner, flush)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            end()
            if value[0] > 0:
                out += _runs(list(value[2]), flush)
        elif kind is op.BRANCH:
            end()
            best = [flush(_runs(list(b), flush)) for b in value[1]]
            if all(best):
                out.append(set().union(*best))
        elif kind is op.ATOMIC_GROUP:
            end()
            out += _runs(list(value), flush)
        elif kind is op.AT:
            pass  # a place, not a sign: the text around it goes on
        else:
            end()
    end()
    return out


def _best(sets: list[set[str]]) -> set[str] | None:
    """The set whose shortest text is longest."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def required_literals(pattern: str) -> frozenset[str] | None:
    """Small texts of which at least one occurs (``folded``) wherever a pattern matches, case ignored; None if nothing of use is known."""
    tree = _parser.parse(pattern, re.IGNORECASE | re.MULTILINE)
    best = _best(_runs(list(tree), _best))
    return frozenset(best) if best and min(map(len, best)) >= LEAST else None


class Finder:
    """Which of many texts occur in a text: an Aho-Corasick automaton, one pass however many there are."""

    def __init__(self, words: list[str]):
        self.words = words
        self.empty = [k for k, w in enumerate(words) if not w]
        self.automaton = None
        try:
            import ahocorasick
        except ImportError:  # slower, the same result
            return
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            if w:
                places.setdefault(w, []).append(k)
        if places:
            self.automaton = ahocorasick.Automaton()
            for w, own in places.items():
                self.automaton.add_word(w, own)
            self.automaton.make_automaton()

    def found(self, text: str) -> set[int]:
        if self.automaton is None:
            return {k for k, w in enumerate(self.words) if w in text}
        out = set(self.empty)
        for _, own in self.automaton.iter(text):
            out.update(own)
        return out


class Patterns:
    """Many patterns of Python's syntax: an automaton says which can match a text, and only those are tried.

    ``needs`` are the ``required_literals`` of the patterns where they are known already.
    """

    def __init__(self, patterns: list[str], needs: list | None = None):
        needs = [required_literals(p) for p in patterns] if needs is None else needs
        self.patterns = patterns
        self.always = [k for k, n in enumerate(needs) if n is None]
        pairs = [(w, k) for k, n in enumerate(needs) if n is not None for w in sorted(n)]
        self.owner = [k for _, k in pairs]
        self.finder = Finder([w for w, _ in pairs])
        self.compiled: dict[int, re.Pattern] = {}

    def candidates(self, text: str) -> list[int]:
        return sorted({*self.always, *(self.owner[w] for w in self.finder.found(folded(text)))})

    def matches(self, text: str, types: list[set[str] | None] | None = None, ext: str | None = None) -> list[tuple[int, list[tuple[int, str, int]]]]:
        """For each pattern that matches: the lines where matches begin, as (number, line, matches). ``types`` says which file types a pattern is for, if not for all."""
        out, lines = [], None
        for k in self.candidates(text):
            if types and types[k] is not None and ext not in types[k]:
                continue
            pattern = self.compiled.get(k)
            if pattern is None:
                pattern = self.compiled[k] = re.compile(self.patterns[k], re.IGNORECASE | re.MULTILINE)
            found: dict[int, int] = {}
            at = place = 0
            for m in pattern.finditer(text):
                at += text.count("\n", place, m.start())
                place = m.start()
                found[at] = found.get(at, 0) + 1
            if found:
                lines = lines or text.split("\n")
                out.append((k, [(n + 1, lines[n], times) for n, times in found.items()]))
        return out


#: Lengths of the stretches of literals that are looked up, and bytes of text that are looked at together.
WIDTHS, CHUNK = (3, 4, 6, 8), 1 << 16
#: Bits of a filter for each literal, and the least and most of all (as powers of two).
BITS, LEAST_BITS, MOST_BITS = 48, 20, 29
#: Bits behind those of a filter, one for each three signs with which a stretch begins: few places of a text get past them.
START_BITS = 24
#: A sign that is in no text.
BETWEEN = b"\xff"
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x165667B19E3779F9)]


def width_of(length: int) -> int:
    """So many signs of a literal are looked up."""
    return max(w for w in WIDTHS if w <= length)


def filter_bits(literals: int) -> int:
    """Size of a filter, as a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, (literals * BITS).bit_length()))


def stretches(words: list[str]) -> list[str]:
    """Of each literal a stretch of its width (among the first 64) that the fewest of the others have, the middle one of such."""
    every = [[w[i : i + n] for i in range(min(64, len(w) - n + 1))] for w, n in ((w, width_of(len(w))) for w in words)]
    counts = Counter(x for own in every for x in own)
    least = [min(map(counts.__getitem__, own)) for own in every]
    rare = [[x for x in own if counts[x] == n] for own, n in zip(every, least, strict=True)]
    return [own[len(own) // 2] for own in rare]


def _salted(windows: np.ndarray, salts: np.ndarray, widths) -> np.ndarray:
    return (windows + salts * _ODD[0] + np.asarray(widths, np.uint64)) * _ODD[1]


def _places(keys: np.ndarray, block, bits: int) -> list[np.ndarray]:
    """Three bits that say that a key is there (the first is cheap), then three that say it is in a block."""
    down = np.uint64(64 - bits)
    more = (keys ^ (keys >> np.uint64(29))) * _ODD[2]
    own = (more ^ (more >> np.uint64(31))) + np.asarray(block, np.uint64) * _ODD[5]
    own = (own ^ (own >> np.uint64(32))) * _ODD[3]
    last = (own ^ (own >> np.uint64(29))) * _ODD[4]
    return [keys >> down, more >> down, (more * _ODD[3]) >> down, own >> down, last >> down, (last * _ODD[2]) >> down]


def literal_places(words: list[str], salts: np.ndarray, blocks: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a filter that literals set, each for the salt of its project and its block of patterns."""
    signs = [w.encode() for w in stretches(words)]
    windows = np.array([int.from_bytes(x, "little") for x in signs], np.uint64)
    starts = (windows & np.uint64((1 << START_BITS) - 1)) + np.uint64(1 << bits)
    return np.concatenate([*_places(_salted(windows, salts, [len(x) for x in signs]), blocks, bits), starts])


class BlockFilter:
    """Which blocks of patterns may match a text, with literals of all in a Bloom filter: never too few, seldom too many."""

    def __init__(self, table: np.ndarray, bits: int, widths: list[int]):
        self.table, self.bits, self.widths = table, bits, sorted(widths)

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.table[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    def blocks(self, texts: list[str], salts: np.ndarray, last: np.ndarray) -> list[set[int]]:
        """For each text the blocks, up to its ``last``, of which it may hold a literal."""
        found: list[set[int]] = [set() for _ in texts]
        pieces, owners, size = [], [], 0
        for k, text in enumerate(texts):
            data = folded(text).encode()
            for at in range(0, len(data), CHUNK):  # pieces of a long text overlap by what a stretch may reach over
                piece = data[at : at + CHUNK + WIDTHS[-1]]
                pieces.append(piece)
                owners.append(k)
                size += len(piece) + 1
                if size >= CHUNK:
                    self._look(pieces, np.array(owners), salts, last, found)
                    pieces, owners, size = [], [], 0
        if pieces:
            self._look(pieces, np.array(owners), salts, last, found)
        return found

    def _look(self, pieces: list[bytes], owners: np.ndarray, salts: np.ndarray, last: np.ndarray, found: list[set[int]]) -> None:
        data = BETWEEN.join([*pieces, bytes(8)])
        lengths = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(lengths)
        starts = np.ndarray((int(ends[-1]),), "<u4", data, strides=(1,)) & np.uint32((1 << START_BITS) - 1)
        begin = np.flatnonzero(self.has(starts.astype(np.uint64) + np.uint64(1 << self.bits)))
        windows = np.ndarray((int(ends[-1]),), "<u8", data, strides=(1,))[begin].astype(np.uint64)  # eight bytes from a place on
        owner = owners[np.searchsorted(ends, begin, side="right")]
        for width in self.widths:
            keys = _salted(windows & np.uint64((1 << 8 * width) - 1), salts[owner], width)
            some = self.has(keys >> np.uint64(64 - self.bits))
            keys, of = keys[some], owner[some]
            for k in (1, 2):
                some = self.has(_places(keys, 0, self.bits)[k])
                keys, of = keys[some], of[some]
            for block in range(int(last[of].max()) + 1) if len(keys) else ():
                hit = last[of] >= block
                for place in _places(keys, block, self.bits)[3:]:
                    hit &= self.has(place)
                for k in np.unique(of[hit]).tolist():
                    found[k].add(block)
