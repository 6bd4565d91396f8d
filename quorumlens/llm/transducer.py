"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary file.

Two deterministic machines, whose transitions say how much they emit:

- Splitter reads characters by class and emits a word border or none. A text is cut into chunks; the map that a chunk
  makes from each state to the state behind it is found for all chunks at once, these maps are composed by a parallel
  prefix scan, which gives the state that each chunk begins in, and all chunks are then run at once.
- Merger reads the bytes of a word and emits by how many tokens the word's count changes. Its states are compiled as
  they are met: one is what the tokens that may still come can see of the word so far.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .tokens import _Known, slices, vocabulary

# ---- Splitter

#: Symbols: letter, number, mark, apostrophe before s t m d, before re ve ll, white space before white space or the end,
#: a space before anything else, other white space before anything else, and what stands for no character.
LETTER, NUMBER, MARK, SHORT, LONG, SPACES, BLANK, BREAK, NONE = range(9)
#: States: between words, in letters, in numbers, in marks, behind a leading blank, in white space, one or two characters before a contraction's end.
FRESH, LETTERS, NUMBERS, MARKS, OPEN, GAP, ONE, TWO = range(8)
STATES = 8


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a word begins) by symbol and state, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?marks|white space not before anything else|white space.
    """
    step, begins = np.zeros((9, STATES), np.uint8), np.zeros((9, STATES), bool)
    fresh = {LETTER: LETTERS, NUMBER: NUMBERS, MARK: MARKS, SHORT: ONE, LONG: TWO, SPACES: GAP, BLANK: OPEN, BREAK: FRESH}
    stays = {(LETTERS, LETTER): LETTERS, (NUMBERS, NUMBER): NUMBERS, (OPEN, LETTER): LETTERS, (OPEN, NUMBER): NUMBERS, (GAP, SPACES): GAP}
    stays |= {(s, m): MARKS for s in (MARKS, OPEN) for m in (MARK, SHORT, LONG)}
    for state in range(STATES):
        step[NONE, state] = state
        for symbol, target in fresh.items():
            if state in (ONE, TWO):
                step[symbol, state] = FRESH if state == ONE else ONE
            elif (state, symbol) in stays:
                step[symbol, state] = stays[state, symbol]
            else:
                step[symbol, state], begins[symbol, state] = target, True
    return step, begins


STEP, BEGINS = _splitter()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The symbol of each code point that needs no look at its neighbours; white space as SPACES.

    The tokenizer's own splitter says it: a character is a letter if it goes on a word of letters, and so on. Planes 4
    to 16 hold marks alone, as far as any of them is assigned.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False, use_regex=True)
    out = np.full(0x110000, SPACES, np.uint8)
    out[0x40000:] = MARK
    for begin in range(0, 0x40000, 0x8000):
        points = [p for p in range(begin, begin + 0x8000) if not 0xD800 <= p < 0xE000]
        for probe, symbol in ((" a", LETTER), (" 1", NUMBER), (" !", MARK)):
            if points:
                words = split.pre_tokenize_str("".join([probe + chr(p) for p in points]))
                ends = np.zeros(3 * len(points) + 1, bool)
                ends[[e for _, (_, e) in words]] = True
                # the probe's own character has no border behind it where the next one goes on its word
                out[np.array(points)[~ends[2 : 3 * len(points) : 3]]] = symbol
    return out


def class_table() -> bytes:
    """The symbols of all code points, four bits each; found once in the driver, half a megabyte."""
    c = _classes()
    return (c[::2] | c[1::2] << 4).tobytes()


def unpacked(table: bytes) -> np.ndarray:
    c = np.frombuffer(table, np.uint8)
    return np.stack([c & 15, c >> 4], axis=1).ravel()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, the byte each begins at) of valid UTF-8."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[places].astype(np.uint32)
    if not len(first) or first.max() < 0x80:
        return first, places
    out, size = first.copy(), np.append(places[1:], len(data)) - places
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(size == n)
        point = first[at] & mask
        for k in range(1, n):
            point = point << 6 | (data[places[at] + k] & 0x3F)
        out[at] = point
    return out, places


def symbols(points: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbols of texts that stand one after another and begin at starts."""
    out = classes[points]
    last = np.zeros(len(points) + 1, bool)  # the text ends behind it
    last[starts - 1] = True
    last[-2:] = True
    last = last[:-1]
    white = out == SPACES
    more = np.append(white[1:], True) | last
    out[white & ~more] = np.where(points[white & ~more] == 0x20, BLANK, BREAK)
    marks = np.flatnonzero((points == 0x27) & ~last)
    one = points[marks + 1]
    out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    two = marks[~last[marks + 1]]
    pair = points[two + 1] << 8 | points[two + 2]
    out[two[np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])]] = LONG
    return out


def word_starts(symbol: np.ndarray, starts: np.ndarray, chunk: int = 64) -> np.ndarray:
    """Whether a word begins at each character, by state maps of chunks and their prefix scan.

    A chunk never spans texts. A text's first chunk begins between words, whatever came before, so its map is
    constant and the scan needs no other care for texts.
    """
    sizes = np.diff(np.append(starts, len(symbol)))
    per = -(-sizes // chunk)
    total = int(per.sum())
    if not total:
        return np.zeros(len(symbol), bool)
    text = np.repeat(np.arange(len(starts)), per)
    place = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[text] + place * chunk
    size = np.minimum(sizes[text] - place * chunk, chunk)
    # chunks as columns; those that are short end with symbols that change nothing
    index = begin + np.arange(chunk)[:, None]
    grid = np.where(np.arange(chunk)[:, None] < size, symbol[np.minimum(index, len(symbol) - 1)], NONE)
    flat = STEP.ravel()
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, total)).copy()
    for row in grid:
        maps = flat[row * np.uint8(STATES) + maps]
    first = np.flatnonzero(place == 0)
    maps[:, first] = maps[FRESH, first]
    # Hillis-Steele: after the round of width d each map covers its chunk and up to 2 d - 1 before it
    d, longest = 1, int(per.max())
    while d < longest:
        behind = maps[:, :-d]
        maps = np.concatenate([maps[:, :d], np.take_along_axis(maps[:, d:], behind, axis=0)], axis=1)
        d *= 2
    state = np.concatenate([[FRESH], maps[FRESH, :-1]]).astype(np.uint8)
    state[first] = FRESH
    flags = np.empty((chunk, total), bool)
    starts_word = BEGINS.ravel()
    for i, row in enumerate(grid):
        key = row * np.uint8(STATES) + state
        flags[i] = starts_word[key]
        state = flat[key]
    out = np.zeros(len(symbol), bool)
    inside = np.arange(chunk)[:, None] < size
    out[index[inside]] = flags[inside]
    return out


# ---- Merger


class Merger:
    """Counts a word's tokens by a deterministic transducer over its bytes, compiled as its states are met.

    In byte pair encoding the tokens of a word are those of its prefixes: each prefix has one last token, the one that
    ends there and stands, pair by pair, behind the last token of where it begins. A state lists the places from
    which a token may still run on: where it is in the trie of all tokens, the last token before it, and by how
    much the count there differs. A transition's number is by how much the count of the prefix changes.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], keep: int = 1_000_000):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.keep = keep
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in [bytes([b]) for b in range(256)] + [a + b for a, b in merges]:
            node = 0
            for b in t:
                node = self.children[node].setdefault(b, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(None)
            self.token[node] = t
        self._whole: dict[bytes, bool] = {}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.number = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """The tokens of a short word by its definition: the pair of least rank is merged, the leftmost first."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _follows(self, before: bytes | None, token: bytes) -> bool:
        """Whether token is its own encoding, and two tokens side by side stay as they are."""
        if token not in self._whole:
            self._whole[token] = self.merged(token) == [token]
        if before is None or not self._whole[token]:
            return self._whole[token]
        pair = (before, token)
        if pair not in self._pairs:
            if len(self._pairs) >= self.keep:
                self._pairs.clear()
            self._pairs[pair] = self.merged(before + token) == [before, token]
        return self._pairs[pair]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        alive, found = [], None
        for node, before, lead in self.states[state]:
            child = self.children[node].get(byte)
            if child is not None:
                token = self.token[child]
                if token is not None and found is None and self._follows(before, token):
                    found = token, lead + 1
                if self.children[child]:
                    alive.append((child, before, lead))
        if found is None:
            raise RuntimeError("a prefix has no last token")
        token, change = found
        after = (*[(node, before, lead - change) for node, before, lead in alive], (0, token, 0))
        number = self.number.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        self.steps[state << 8 | byte] = number, change
        return number, change

    def count(self, word: bytes) -> int:
        steps, state, n = self.steps, 0, 0
        for b in word:
            hit = steps.get(state << 8 | b)
            if hit is None:
                hit = self._compile(state, b)
            state = hit[0]
            n += hit[1]
        return n

    def counts(self, words: list[bytes]) -> np.ndarray:
        if len(self.steps) > self.keep:
            self._reset()
        return np.fromiter(map(self.count, words), np.int64, len(words))


# ---- both


def _byte_letters() -> dict[str, int]:
    """Which byte each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Counter:
    """Token counts of whole texts for one vocabulary file of the tokenizers library: byte-level BPE, split by its pattern."""

    def __init__(self, path: str, classes: np.ndarray | None = None, keep_words: int = 1_000_000, keep_bytes: int = 30_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or not byte_level or spec.get("normalizer") or odd:
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that look at their neighbours are not compiled")
        self.added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=lambda t: (-len(t), t))
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if len({a + b for a, b in merges}) < len(merges):
            raise ValueError("a token comes from two merges")
        self.merger = Merger(merges)
        self.classes = _classes() if classes is None else classes
        self.keep_words, self.keep_bytes = keep_words, keep_bytes
        self.words = _Known("binary")

    def _learn(self, new) -> tuple[np.ndarray, np.ndarray]:
        n = self.merger.counts(new.to_pylist())
        return n.astype(np.uint32), np.ones(len(new), np.int64)

    def _word_counts(self, words) -> np.ndarray:
        """The count of each word (Arrow binaries), by a table of words met before."""
        if len(self.words.strings) > self.keep_words or self.words.strings.nbytes > self.keep_bytes:
            self.words = _Known("binary")
        codes = self.words.codes(words, self._learn)  # a word's one "id" is its count
        return self.words.store[self.words.offset[codes]].astype(np.int64)

    def count(self, texts) -> np.ndarray:
        """The number of tokens of each text of an Arrow array of strings without nulls; an added token is one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, np.int64)
        lists = texts
        if self.added:
            import re

            lists = pc.split_pattern_regex(lists, "|".join(re.escape(t) for t in self.added))
            per = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = lists.flatten()
        else:
            per, parts = np.ones(len(texts), np.int64), lists
        length = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(parts)], pa.int64()), parts), "")[0].as_buffer(), np.uint8)
        if not len(data):
            return per - 1
        points, places = code_points(data)
        part_begin = np.cumsum(length) - length
        full = np.flatnonzero(length > 0)
        starts = np.searchsorted(places, part_begin[full])
        borders = places[word_starts(symbols(points, starts, self.classes), starts)]
        offsets = np.append(borders, len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(borders), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        before = np.concatenate([[0], np.cumsum(self._word_counts(words))])
        # words of a part: from its first byte on to the next part's
        ends = np.searchsorted(borders, part_begin + length)
        tokens = before[ends] - before[np.searchsorted(borders, part_begin)]
        through = np.concatenate([[0], np.cumsum(tokens)])
        last = np.cumsum(per)
        return through[last] - through[last - per] + per - 1


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of the text; columns of these names are overwritten.

    A null text counts as empty: no bytes, no tokens. Texts are read whole, in slices of some megabytes; repeated rows
    and ids are counted each for itself, an empty table gives no rows. The counts are those of the vocabulary file's own
    library without special tokens around; a special token's string inside a text is one token, which is its default.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    cols = [c for c in docs.columns if c not in (text, *added)]
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)], text_or_empty(text).alias("_text"))
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(class_table())  # half a megabyte, whatever the data

    def count(parts: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, unpacked(table.value))
        for part in parts:
            texts = part.column(len(cols))
            for s in slices(texts, 8_000_000):
                some = part.slice(s.start, s.stop - s.start)
                column = some.column(len(cols))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(cols)], pc.binary_length(column).cast(pa.int64()), pa.array(_COUNTERS[path].count(column))],
                    [*[f"_c{i}" for i in range(len(cols))], "n_bytes", "n_tokens"],
                )

    fields = ", ".join([*[f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(cols)], "n_bytes long", "n_tokens long"])
    found = rows.mapInArrow(count, fields)
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_transducer(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, vocabulary("byte_bpe_50k.json"))
