"""Token ids by a public tokenizer, its vocabulary file being a parameter."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np

#: Ends each document; an ordinary id of word_bpe_49k.json.
END_ID = 2
#: Bytes of text that a worker encodes at once: what it holds for a slice is some thirty times this.
SLICE = 2_000_000
#: Marks that may follow a word in its chunk. They are ASCII, so none composes with what stands before it or changes case.
_TAIL = "#*$%&|<>.,;:!?)]}\"-_=+~^/"
#: How texts are cut behind the normalizer: contractions, runs of letters, single numbers, runs of marks; white space goes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known:
    """Strings that were seen, in an Arrow array, and the id sequence of each."""

    def __init__(self, kind: str = "string"):
        import pyarrow as pa

        self.strings = pa.array([], kind)
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offset, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def add(self, strings, ids: np.ndarray, sizes: np.ndarray) -> None:
        import pyarrow as pa

        self.strings = pa.concat_arrays([self.strings, strings])
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(max(len(self.store) // 2, len(ids)), np.uint32)])
        self.store[self.used : self.used + len(ids)] = ids
        self.offset = np.concatenate([self.offset, (self.used + np.cumsum(sizes) - sizes).astype(np.uint32)])
        self.size = np.concatenate([self.size, sizes.astype(np.uint32)])
        self.used += len(ids)

    def ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of these codes one after another, and the size of each."""
        sizes = self.size[codes].astype(np.int64)
        after = np.cumsum(sizes)
        at = np.repeat(self.offset[codes] - after + sizes, sizes)
        at += np.arange(len(at))
        return self.store[at], sizes

    def codes(self, strings, learn) -> np.ndarray:
        """Each string's code; learn(new strings) gives the ids and sizes of those not seen before."""
        import pyarrow.compute as pc

        numbered = strings.dictionary_encode()
        distinct = numbered.dictionary
        found = pc.index_in(distinct, value_set=self.strings)
        if found.null_count:
            new = distinct.filter(pc.is_null(found))
            codes = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).copy()
            codes[codes < 0] = np.arange(len(new)) + len(self.strings)
            self.add(new, *learn(new))
        else:
            codes = found.to_numpy(zero_copy_only=False)
        return codes[numbered.indices.to_numpy(zero_copy_only=False)]


def _steps(part: dict | None, name: str) -> list[dict]:
    return [] if not part else part[name] if part["type"] == "Sequence" else [part]


def parts_at_spaces(spec: dict) -> bool:
    """Whether a vocabulary file's texts may be cut at spaces: what it normalizes, splits and adds never crosses one.

    NFC composes nothing with a space, lower case is by character, runs of white space become one and are dropped by
    WORDS, which has no piece with white space in it; no added token holds white space or looks at its neighbours.
    """
    calm = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
    cut = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    split = [{k: v for k, v in step.items() if k != "trim_offsets"} for step in _steps(spec.get("pre_tokenizer"), "pretokenizers")]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(map(str.isspace, t["content"]))) for t in spec.get("added_tokens", []))
    return plain and all(step in calm for step in _steps(spec.get("normalizer"), "normalizers")) and split == [cut, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]


class Encoder:
    """The ids of whole texts, each followed by the end id.

    The vocabulary file's normalizer and splitter never cross a space (parts_at_spaces() reads them), so a text's ids
    are those of its space-separated chunks in order. Arrow splits texts and numbers the distinct chunks of a batch. A
    chunk of letters with marks behind is a word and a tail, if the word still ends in a letter when it is normalized.
    ASCII chunks are put in lower case, so that fewer are distinct. Chunks that hold an added token, in any case of its
    letters, are neither cut nor changed. The tokenizer sees each word and tail once while it is known; words are
    forgotten as they come to more than `keep` or keep_bytes bytes. Chunks are forgotten at a quarter as many, as cutting
    them into known words costs little. Texts are best given in slices() of SLICE bytes.
    """

    def __init__(self, path: str, keep: int = 500_000, keep_bytes: int = 15_000_000, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not parts_at_spaces(spec):
            raise ValueError("this tokenizer does not part texts at spaces")
        self.tokenizer, self.keep, self.keep_bytes, self.end_id = Tokenizer.from_file(path), keep, keep_bytes, end_id
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.lower = {"type": "Lowercase"} in _steps(spec.get("normalizer"), "normalizers")
        vocab = self.tokenizer.get_vocab()
        self.largest = max(vocab.values(), default=0)
        self.ends = np.zeros(self.largest + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._letters: dict[str, bool] = {}
        self.chunks, self.words = _Known(), _Known()

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings one after another, and each one's number of ids."""
        found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for s in range(0, len(strings), 10_000):  # an encoding takes some hundred times its string's memory
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(strings[s : s + 10_000], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            found.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(counts[-1].sum())))
        return np.concatenate(found), np.concatenate(counts)

    def _encode_words(self, new) -> tuple[np.ndarray, np.ndarray]:
        """As _each(), but many words of letters to a string: each has an end or more, so as many ends mean one each."""
        import pyarrow.compute as pc

        letters = pc.utf8_is_alpha(new)
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        words = new.filter(letters)
        for s in range(0, len(words), 1000):
            some = words[s : s + 1000].to_pylist()
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(some) and ends[-1] == len(ids) - 1:
                n = np.diff(ends, prepend=-1)
            else:
                ids, n = self._each(some)
            found.append(ids)
            sizes.append(n)
        ids, n = self._each(new.filter(pc.invert(letters)).to_pylist())
        mask = letters.to_numpy(zero_copy_only=False)
        order = np.empty(len(new), np.int64)  # each string's place among words, then the others
        order[mask] = np.arange(mask.sum())
        order[~mask] = mask.sum() + np.arange((~mask).sum())
        both = _Known()
        both.add(new.slice(0, 0), np.concatenate([*found, ids]), np.concatenate([*sizes, n]))
        return both.ids(order)

    def _ends_in_letter(self, word: str) -> bool:
        """Whether a word as the tokenizer normalizes it ends in what it takes for a letter."""
        normalizer = self.tokenizer.normalizer
        last = (normalizer.normalize_str(word) if normalizer else word)[-1:]
        if last not in self._letters:
            self._letters[last] = bool(last) and len(self.tokenizer.pre_tokenizer.pre_tokenize_str("a" + last)) == 1
        return self._letters[last]

    def _encode_chunks(self, new) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        ascii_only = pc.string_is_ascii(new)
        special = pa.array(np.zeros(len(new), bool))
        for token in self.added:
            special = pc.or_(special, pc.match_substring(new, token, ignore_case=True))
        if self.lower:
            new = pc.if_else(pc.and_not(ascii_only, special), pc.ascii_lower(new), new)
        words = pc.utf8_rtrim(new, characters=_TAIL)
        split = pc.and_(pc.utf8_is_alpha(words), pc.less(pc.binary_length(words), pc.binary_length(new)))
        split = pc.and_not(split, special)
        doubtful = pc.and_not(split, ascii_only)
        if pc.any(doubtful).as_py():
            fine = split.to_numpy(zero_copy_only=False).copy()
            at = np.flatnonzero(doubtful.to_numpy(zero_copy_only=False))
            fine[at] = np.fromiter(map(self._ends_in_letter, words.filter(doubtful).to_pylist()), bool, len(at))
            split = pa.array(fine)
        # words and tails in turn, from the bytes of the chunks; a chunk that is not parted has an empty tail
        size = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        cut = begin + np.where(split.to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy(zero_copy_only=False), size)
        offsets = np.append(np.stack([begin, cut], axis=1).ravel(), size.sum()).astype(np.int32)
        data = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(new)], pa.int64()), new), "")[0].as_buffer()
        pieces = pa.StringArray.from_buffers(2 * len(new), pa.py_buffer(offsets), data)
        ids, sizes = self.words.ids(self.words.codes(pieces, self._encode_words))
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids; a null text has the end id alone.

        texts: an Arrow array of strings, or a list of them.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.words.strings) > self.keep or self.words.strings.nbytes > self.keep_bytes:
            self.words = _Known()
        if len(self.chunks.strings) > self.keep // 4 or self.chunks.strings.nbytes > self.keep_bytes:
            self.chunks = _Known()
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(column, ""), "\n", " "), " ")
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        body, sizes = self.chunks.ids(self.chunks.codes(lists.flatten(), self._encode_chunks))
        after = np.concatenate([[0], np.cumsum(sizes)])
        sizes = np.diff(after[np.concatenate([[0], np.cumsum(per)])]) + 1
        ids = np.full(len(body) + len(sizes), self.end_id, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(sizes) - 1] = False
        ids[inside] = body
        return ids, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_width(path: str) -> int:
    """Bytes that hold any id of a vocabulary file and the end id: 2 or 4."""
    return 2 if max(encoder(path).largest, END_ID) < 1 << 16 else 4


def slices(texts, most_bytes: int = 16_000_000) -> Iterator[slice]:
    """Slices of an Arrow array of strings with about most_bytes bytes, one text at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def batches(texts: list[str | None], most_chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of texts with about most_chars characters, one text at least."""
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t or "") > most_chars:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += len(t or "")
    if begin < len(texts):
        yield slice(begin, len(texts))
