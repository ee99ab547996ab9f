"""Token ids of whole texts, each distinct unit of text being given to the library once.

No piece that the two tokenizers' patterns cut holds white space after another
character, so a text may be cut before any white space that follows such a
character, and its ids are those of its units behind each other.  A bounded
table keeps the units met before; those not met yet are encoded many at a time,
as one text.  A tokenizer of another pattern gets every text whole.

Special tokens that stand in a text get their own ids, as the library gives them.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

# White space as the tokenizers' patterns mean it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pattern of the tokenizer that drops white space, as in its file.
_DROPPING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_UNITS = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_MARK = "\x00"
_MARKS = ".,;:!?"
#: Latin letters, which the normaliser of the tokenizer that drops white space only lower-cases (but U+0130, which becomes two characters).
_LATIN = re.compile(r"[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")

#: Units of a generation of the table; the one before is kept besides.
TABLE_UNITS = 300_000


class _Wide(Exception):
    """White space after the space that a unit was cut at: the cut may part a piece."""


class _Places(dict):
    """The place of each unit in its generation's table.  A unit not met yet gets the next place: its ids come from the generation before, or are to be found."""

    def __init__(self, count: Iterator[int], refused, older: dict):
        super().__init__()
        self.count, self.refused, self.older = count, refused, older
        self.new: list[str] = []  # units to be found, and their places
        self.new_at: list[int] = []
        self.known: list[int] = []  # places of units of the generation before, there and here
        self.known_at: list[int] = []

    def __missing__(self, unit: str) -> int:
        if self.refused(unit):
            raise _Wide
        self[unit] = place = next(self.count)
        older = self.older.get(unit)
        if older is None:
            self.new.append(unit)
            self.new_at.append(place)
        else:
            self.known.append(older)
            self.known_at.append(place)
        return place

    def settled(self) -> None:
        for some in (self.new, self.new_at, self.known, self.known_at):
            some.clear()


class _Generation:
    """Ids of units: those of place p are ids[starts[p] : starts[p] + sizes[p]]."""

    def __init__(self, end_id: int, refused, before: _Generation | None = None):
        count = itertools.count(1)  # place 0 is the end id
        self.spaced = _Places(count, refused, before.spaced if before else {})  # units after a space, which is left out
        self.plain = _Places(count, lambda unit: False, before.plain if before else {})
        self.ids, self.starts, self.sizes = np.array([end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.before = before

    def forget(self) -> None:
        """Let go of the generation before."""
        self.before, self.spaced.older, self.plain.older = None, {}, {}

    def add(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Ids behind each other, the places they belong to and how many each place takes."""
        n = max([len(self.starts), *(int(places.max()) + 1 for _, places, _ in parts if len(places))])
        starts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        starts[: len(self.starts)], sizes[: len(self.sizes)] = self.starts, self.sizes
        at = len(self.ids)
        for ids, places, size in parts:
            sizes[places], starts[places] = size, at + np.cumsum(size) - size
            at += len(ids)
        self.ids, self.starts, self.sizes = np.concatenate([self.ids, *(ids for ids, _, _ in parts)]), starts, sizes

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of places behind each other, and how many each has."""
        size = self.sizes[places]
        from_ = np.repeat(self.starts[places] - np.cumsum(size) + size, size)
        from_ += np.arange(len(from_))
        return self.ids[from_], size


class Encoder:
    """Ids of texts under a tokenizer file, an end id after each text."""

    def __init__(self, path: str, end_id: int = 0, table_units: int = TABLE_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.end_id, self.most = end_id, table_units
        cuts = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        parts = cuts.get("pretokenizers", [])
        mark = self._ids([_MARK])[0]
        self.keeps = cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts.get("add_prefix_space")
        self.drops = len(mark) == 1 and len(parts) == 2 and parts[0].get("pattern") == {"Regex": _DROPPING} and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex")
        self.opens = np.zeros(self.vocabulary, bool)  # ids that open a unit of the first kind, or stand between units of the second
        self.opens[mark if self.drops else [i for i in range(self.vocabulary) if self.tokenizer.id_to_token(i).startswith("Ġ")]] = True
        self.bare = self.closes = None
        if self.drops:
            self.bare = Tokenizer.from_file(path)  # for Latin letters in lower case, of which every unit is one piece
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.closes = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.vocabulary)])  # ids that end a piece
        self.refused = (lambda unit: not unit or _MARK in unit) if self.drops else (lambda unit: not unit or unit[0].isspace())
        self.table = _Generation(end_id, self.refused)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _places(self, text: str) -> np.ndarray:
        if self.drops:
            text = text.replace("\n", " ")
            if text.isascii() and "<|" not in text:
                text = text.lower()
        units, spaced, plain = text.split(" "), self.table.spaced, self.table.plain
        try:
            if self.drops:
                return np.fromiter(map(spaced.__getitem__, units), np.int64, len(units))
            return np.fromiter(chain((plain[units[0]],), map(spaced.__getitem__, units[1:])), np.int64, len(units))
        except _Wide:
            if self.drops:
                return np.array([plain[u] if self.refused(u) else spaced[u] for u in units])
            return np.array([spaced[u[1:]] if u[0] == " " and not self.refused(u[1:]) else plain[u] for u in _UNITS.findall(text)])

    def _together(self, units: list[str], places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of units from one text that holds them all; None if they cannot be told apart there."""
        text = f" {_MARK} ".join(["", *units]) if self.drops else " " + " ".join(units)
        ids = np.array(self._ids([text])[0], np.uint32)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) != len(units):
            return None
        size = np.diff(np.append(begin, len(ids)))
        if self.drops:
            ids, size = ids[~self.opens[ids]], size - 1
        return ids, np.array(places), size

    def _letters(self, units: list[str], places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units of Latin letters only, each of which is a piece: the tokens that end one tell them apart."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(units).lower()], add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.array(places), np.diff(np.append(-1, np.flatnonzero(self.closes[ids])))

    def _learn(self) -> None:
        """Find the ids of the units met since."""
        table, parts = self.table, []
        # A Latin word and a mark after it are two pieces, and the word may be known.
        pairs = [(u, p) for u, p in zip(table.spaced.new, table.spaced.new_at) if u[-1] in _MARKS and _LATIN.fullmatch(u, 0, len(u) - 1)]
        if pairs:
            gone, mark = {p for _, p in pairs}, table.spaced if self.drops else table.plain
            pairs = [(p, table.spaced[u[:-1]], mark[u[-1]]) for u, p in pairs]
            kept = [p not in gone for p in table.spaced.new_at]
            table.spaced.new[:], table.spaced.new_at[:] = itertools.compress(table.spaced.new, kept), itertools.compress(table.spaced.new_at, kept)
        for some in (table.spaced, table.plain):
            if some.known:
                ids, size = table.before.of(np.array(some.known))
                parts.append((ids, np.array(some.known_at), size))
        units, places = table.spaced.new, table.spaced.new_at
        if self.drops:
            latin = list(map(bool, map(_LATIN.fullmatch, units)))
            words, at = list(itertools.compress(units, latin)), list(itertools.compress(places, latin))
            parts += [self._letters(words[k : k + 4096], at[k : k + 4096]) for k in range(0, len(words), 4096)]
            other = [not yes for yes in latin]
            units, places = list(itertools.compress(units, other)), list(itertools.compress(places, other))
        apart, apart_at = list(table.plain.new), list(table.plain.new_at)
        for at in range(0, len(units), 4096):
            some, some_at = units[at : at + 4096], places[at : at + 4096]
            found = self._together(some, some_at)
            if found:
                parts.append(found)
            else:
                apart += some if self.drops else [" " + u for u in some]
                apart_at += some_at
        if apart:
            found = self._ids(apart)
            parts.append((np.array(list(chain.from_iterable(found)), np.uint32), np.array(apart_at), np.array(list(map(len, found)))))
        table.add(parts)
        if pairs:
            places = np.array(pairs)
            ids, size = table.of(places[:, 1:].ravel())
            table.add([(ids, places[:, 0], size.reshape(-1, 2).sum(1))])
        table.spaced.settled()
        table.plain.settled()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids behind each other, each text's followed by the end id, and where each text's begin (one more than texts); a null is an empty text."""
        if not (self.keeps or self.drops):
            ids = [[*x, self.end_id] for x in self._ids([t or "" for t in texts])]
            return np.array(list(chain.from_iterable(ids)), np.uint32), np.cumsum([0, *map(len, ids)])
        if len(self.table.starts) > self.most:
            self.table.forget()
            self.table = _Generation(self.end_id, self.refused, self.table)
        end, none = np.zeros(1, np.int64), np.zeros(0, np.int64)
        places = [self._places(t) if t else none for t in texts]
        self._learn()
        ids, size = self.table.of(np.concatenate([none, *(x for p in places for x in (p, end))]))
        through = np.concatenate([[0], np.cumsum(size)])
        return ids, through[np.cumsum([0, *(len(p) + 1 for p in places)])]


_encoders: dict[tuple[str, int, int], Encoder] = {}


def encoder(path: str, end_id: int = 0, table_units: int = TABLE_UNITS) -> Encoder:
    """The worker's encoder of a file, kept from task to task."""
    key = (path, end_id, table_units)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
