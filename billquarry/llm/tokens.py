"""Token counts by rank-synchronous merging of byte pairs.

Pre-tokens of many texts are held as one ragged numpy array of symbol ids. In each round every
sequence applies its own lowest-rank pair, all sequences at once; a sequence without a known pair
is finished, and the symbols that survive are its tokens.

Texts are first cut before single spaces between two printing characters. No pre-token of the
byte-level pattern reaches over such a space, so the pieces can be encoded one by one, and a task
encodes a piece only once while it is remembered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billquarry.llm.shared import small_batches

#: Fixed value: pre-token pattern of the byte-level vocabulary, as its library has it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a task remembers, and characters it works on at a time.
REMEMBERED = 400_000
CHARACTERS = 1 << 20
NONE = np.int32(2**31 - 1)

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_TWO_SPACES = re.compile(r"\s\s")


class PairRanks:
    """Merge ranks of a byte-level vocabulary in an open-addressing table of numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary, merges = stored["model"]["vocab"], stored["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.width = max([*vocabulary.values(), *self.specials.values()]) + 1
        letters = _byte_letters()
        self.dtype = np.dtype("<u2" if self.width <= 1 << 16 else "<u4")
        self.of_byte = np.array([vocabulary[letters[b]] for b in range(256)], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        self.shift = np.uint64(64 - max(8, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int32)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the vocabulary does not merge it."""
        keys = left.astype(np.int64) * self.width + right
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) % len(self.keys)
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return found

    def merge(self, raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive in each byte sequence of ``raw``: ids one after the other, and how many each has. No sequence is empty."""
        count = len(lengths)
        symbols = self.of_byte[np.frombuffer(raw, dtype=np.uint8)]
        owner = np.arange(count)
        ranks = np.full(len(symbols), NONE, dtype=np.int32)
        if len(symbols) > 1:
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
            ranks[np.cumsum(lengths) - 1] = NONE  # the last symbol of a sequence has no right neighbour
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(owner):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == NONE
            if over.any():
                which = np.repeat(over, lengths)
                done.append((owner[over], lengths[over], symbols[which]))
                owner, lengths, lowest, symbols, ranks = owner[~over], lengths[~over], lowest[~over], symbols[~which], ranks[~which]
                if not len(owner):
                    break
                starts = np.cumsum(lengths) - lengths
            at = np.flatnonzero(ranks == np.repeat(lowest, lengths))
            first = np.ones(len(at), dtype=bool)
            first[1:] = at[1:] != at[:-1] + 1
            if not first.all():  # of pairs that overlap (aaa) every second one counts, from the left
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[at + 1] = False
            lengths = np.add.reduceat(stays, starts, dtype=np.int64)
            changed = np.zeros(len(symbols), dtype=bool)
            changed[at] = True
            symbols, ranks, changed = symbols[stays], ranks[stays], changed[stays]
            changed[:-1] |= changed[1:]
            ends = np.cumsum(lengths) - 1
            changed[ends] = False
            ranks[ends] = NONE
            again = np.flatnonzero(changed)
            ranks[again] = self.rank(symbols[again], symbols[again + 1])
        sizes = np.zeros(count, dtype=np.int64)
        for own, length, _ in done:
            sizes[own] = length
        ids = np.empty(int(sizes.sum()), dtype=np.int32)
        places = np.cumsum(sizes) - sizes
        for own, length, part in done:
            ids[np.repeat(places[own] - (np.cumsum(length) - length), length) + np.arange(len(part))] = part
        return ids, sizes


@lru_cache(maxsize=4)
def ranks_of(path: str) -> PairRanks:
    return PairRanks(path)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: its own, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def segments(text: str) -> Iterator[str]:
    """Cut a long text before single spaces, so that no more than about CHARACTERS are held as pieces."""
    at = 0
    while len(text) - at > CHARACTERS and (cut := _SAFE_SPACE.search(text, at + CHARACTERS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def pieces(segment: str) -> list[str]:
    """Pieces of a segment; each but the first has a space before it."""
    return _SAFE_SPACE.split(segment) if _TWO_SPACES.search(segment) else segment.split(" ")


class Encoder:
    """Encodes texts of one vocabulary; remembers a bounded number of pieces.

    ``as_bytes``: a piece gives its ids as little-endian bytes; otherwise the number of its ids.
    """

    def __init__(self, path: str, as_bytes: bool = False):
        self.ranks, self.as_bytes = ranks_of(path), as_bytes
        self.dtype = self.ranks.dtype
        self.pattern = regex.compile(PRE_TOKEN)
        specials = sorted(self.ranks.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.join, self.nothing = (b"".join, b"") if as_bytes else (sum, 0)
        #: Values of pieces with a space before them, by what follows the space; the generation before is kept for one more.
        self.known: dict[str, object] = {}
        self.older: dict[str, object] = {}
        self.marks: dict[str, object] = dict(zip(".,;:!?", self._values(list(".,;:!?"))))

    def _each(self, raw: bytes, lengths: np.ndarray) -> list[object]:
        """Value of each byte sequence of ``raw``."""
        ids, sizes = self.ranks.merge(raw, lengths)
        if not self.as_bytes:
            return sizes.tolist()
        ends = np.cumsum(sizes) * self.dtype.itemsize
        held = ids.astype(self.dtype).tobytes()
        return [held[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _values(self, parts: list[str]) -> list[object]:
        """Value of each piece: its pre-tokens are merged together with those of the others, each distinct one once."""
        found = [self.pattern.findall(p) for p in parts]
        distinct = list(dict.fromkeys(chain.from_iterable(found)))
        raw = [t.encode("utf-8", "surrogatepass") for t in distinct]
        of = dict(zip(distinct, self._each(b"".join(raw), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))))
        return [of[ts[0]] if len(ts) == 1 else self.join([of[t] for t in ts]) for ts in found]

    def _learn(self, missing: list[str]) -> None:
        """Values of pieces that have a space before them.

        A space and letters are one pre-token, and a mark after them a second one; these frequent kinds need no pattern.
        """
        known, older = self.known, self.older
        words: dict[str, None] = {}
        marked, rest = [], []
        for p in dict.fromkeys(missing):
            if (value := older.get(p)) is not None:
                known[p] = value
            elif p.isalpha():
                words[p] = None
            elif p and p[-1] in self.marks and p[:-1].isalpha():
                marked.append(p)
                if p[:-1] not in known:
                    words[p[:-1]] = None
            else:
                rest.append(p)
        if words:
            raw = (" " + " ".join(words)).encode("utf-8", "surrogatepass")
            starts = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 32)
            ends = np.append(starts[1:], len(raw))
            # the space that parts two words is the one that begins the second
            known.update(zip(words, self._each(raw, ends - starts)))
        for p in marked:
            known[p] = known[p[:-1]] + self.marks[p[-1]]
        if rest:
            known.update(zip(rest, self._values([" " + p for p in rest])))

    def _encode(self, cut: list[list[str]]) -> list[object]:
        """Value of each segment, given as its pieces."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, get = self.known, self.known.get
        looked = [list(map(get, parts)) for parts in cut]
        starts = {p: i for i, p in enumerate(dict.fromkeys(parts[0] for parts in cut if parts[0]))}
        first = self._values(list(starts))
        for parts, values in zip(cut, looked):  # a first piece has no space before it, so what is known does not hold for it
            values[0] = first[starts[parts[0]]] if parts[0] else self.nothing
        missing = [p for parts, values in zip(cut, looked) for p, v in zip(parts, values) if v is None]
        if missing:
            self._learn(missing)
            looked = [[known[p] if v is None else v for p, v in zip(parts, values)] for parts, values in zip(cut, looked)]
        return [self.join(values) for values in looked]

    def encode(self, texts: list[str | None]) -> list[object]:
        """The ids (bytes) or the number of ids of each text; a missing text is empty."""
        out: list[list[object]] = [[] for _ in texts]
        held: list[tuple[int, object]] = []
        room = 0
        for i, text in enumerate(texts):
            for part, special in self._parts(text or ""):
                if special is not None:  # waits among the pieces, so that the order is kept
                    held.append((i, np.array([special], dtype=self.dtype).tobytes() if self.as_bytes else 1))
                    continue
                for segment in segments(part):
                    held.append((i, pieces(segment)))
                    room += len(segment)
                    if room > CHARACTERS:
                        self._work_off(held, out)
                        room = 0
        self._work_off(held, out)
        return [values[0] if len(values) == 1 else self.join(values) for values in out]

    def _work_off(self, held: list[tuple[int, object]], out: list[list[object]]) -> None:
        values = iter(self._encode([parts for _, parts in held if isinstance(parts, list)]))
        for i, parts in held:
            out[i].append(next(values) if isinstance(parts, list) else parts)
        held.clear()

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary text and special tokens in turn."""
        specials = self.ranks.specials
        if not any(s in text for s in specials):
            yield text, None
            return
        for part in self.special.split(text):
            if part:
                yield part, specials.get(part)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is the path of a byte-level BPE file on every executor. A missing or empty text has
    no tokens. Special strings inside a text count as one token each, as is the library's default.
    A text of any length is worked on in pieces. Columns of these three names in ``docs`` are replaced; all others stay.
    """
    small_batches(docs.sparkSession)
    others = [F.col(_quoted(c)) for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    value = F.coalesce(F.col(_quoted(text)), F.lit(""))
    return docs.select(*others, F.octet_length(value).cast("long").alias("n_bytes"), _counter(vocabulary)(value).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _counter(vocabulary: str):
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(vocabulary)
        for texts in batches:
            yield pd.Series(encoder.encode(texts.tolist()), dtype="int64")

    return count
