"""Batch encoding with the tokenizers of public vocabulary files, inside Arrow functions.

``encoder(path, lengths)`` gives a function from a list of texts to a list of token counts
(``lengths``) or of token ids (little-endian unsigned 32-bit, as bytes), as the file's
library gives them without special tokens. One encoder is kept per Python worker.

Texts over ``PART_CHARS`` are encoded in parts. A part ends between a non-space and a single
space that a non-space follows. No pre-token reaches over such a place in any of the three
kinds of file, so the parts' tokens are those of the text:

* sentence pieces: no piece has a space mark inside; the space that the library puts before
  a text stands for the one that was cut.
* byte-level BPE: a pre-token has a space only as its first character or among other spaces.
* word BPE: white space is dropped, and what it separates is encoded by itself.

The last kind allows more: a text's tokens are those of its white-space separated words, so
each worker encodes a word once and remembers it (bounded, see ``WORDS``).
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np

PART_CHARS = 1 << 18
#: Words and letter cores remembered by a worker; at that many it starts anew.
WORDS = 400_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CACHE: dict = {}


def split_safe(text: str, size: int = PART_CHARS) -> list[str]:
    """``text`` in parts of about ``size`` characters; later parts start with the space at the cut."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


def encoder(path: str, lengths: bool) -> Callable[[list[str]], list]:
    key = (path, lengths)
    if key not in _CACHE:
        if path.endswith(".json"):
            made = _WordEncoder(path, lengths) if _words_alone(path) else _JsonEncoder(path, lengths)
        else:
            made = _PieceEncoder(path, lengths)
        _CACHE[key] = made
    return _CACHE[key]


def _words_alone(path: str) -> bool:
    """Whether the file cuts texts at white space and drops it, and its words' last tokens are marked."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec.get("pre_tokenizer") or {}
    first = cut.get("pretokenizers", [cut])[0]
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    levels = [x.get("type") for x in cut.get("pretokenizers", [])]
    steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    whole = not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"])
    return bool(kept and whole and levels == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"]
                and spec["model"].get("end_of_word_suffix"))


class _Parts:
    """Encodes texts in parts: ``many`` takes a list of parts and gives counts or ids."""

    lengths: bool

    def many(self, parts: list[str]) -> list:
        raise NotImplementedError

    def __call__(self, texts: list[str]) -> list:
        split = [split_safe(x) for x in texts]
        found = iter(self.many(list(itertools.chain.from_iterable(split))))
        empty = 0 if self.lengths else b""
        join = sum if self.lengths else empty.join
        return [join(itertools.islice(found, len(x))) for x in split]

    def value(self, ids) -> int | bytes:
        return len(ids) if self.lengths else np.asarray(ids, "<u4").tobytes()


class _JsonEncoder(_Parts):
    def __init__(self, path: str, lengths: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.lengths, self.tokenizer = lengths, Tokenizer.from_file(path)

    def many(self, parts):
        return [self.value(x.ids) for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class _PieceEncoder(_Parts):
    def __init__(self, path: str, lengths: bool):
        from sentencepiece import SentencePieceProcessor

        self.lengths, self.processor = lengths, SentencePieceProcessor(model_file=path)

    def __call__(self, texts):
        split = [[part.removeprefix(" ") if n else part for n, part in enumerate(split_safe(x))] for x in texts]
        found = iter(self.many(list(itertools.chain.from_iterable(split))))
        join = sum if self.lengths else b"".join
        return [join(itertools.islice(found, len(x))) for x in split]

    def many(self, parts):
        return [self.value(x) for x in self.processor.encode(parts, num_threads=1)]


class _WordEncoder(_JsonEncoder):
    """Word by word. Unseen words of letters are encoded together in one call: each ends with
    a marked token, which tells them apart again. Other words are encoded one by one."""

    #: Python's split() takes these for white space, the tokenizer doesn't.
    ODD = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str, lengths: bool):
        super().__init__(path, lengths)
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.words: dict[str, int | bytes] = {}
        self.cores: dict[str, int | bytes] = {}
        # For lower-case NFC letters the normaliser and the cut change nothing; bytes are mapped here.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, WhitespaceSplit()
        mark = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith(mark)]] = True
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {}  # of each letter: its UTF-8 bytes as the vocabulary writes them
        for c in map(chr, range(0x61, 0x180)):
            if c.isalpha():
                self.bytes[ord(c)] = level.pre_tokenize_str(c)[0][0]
        self.tails = {x: self.value(self.tokenizer.encode(x, add_special_tokens=False).ids) for x in ".,"}

    def __call__(self, texts):
        if any(len(x) > PART_CHARS for x in texts):
            return super().__call__(texts)
        return self.many(texts)

    def many(self, parts):
        split = [re.split("[ \t\n]+", x.strip(" \t\n")) if any(c in x for c in self.ODD) else x.split() for x in parts]
        new = set(itertools.chain.from_iterable(split)).difference(self.words)
        if new:
            if len(self.words) + len(new) > WORDS:
                self.words.clear()
                new = set(itertools.chain.from_iterable(split))
            self.learn(new)
        value = self.words.__getitem__
        join = sum if self.lengths else b"".join
        return [join(map(value, x)) for x in split]

    def learn(self, new: set[str]) -> None:
        single, whole, cores = [], [], {}
        known, tails = self.cores, self.tails
        words = list(new)
        for word, core in zip(words, " ".join(words).lower().split(" "), strict=True):
            tail = ""
            if not core.isalpha():
                tail, core = core[-1:], core[:-1]
                if tail not in tails or not core.isalpha():
                    single.append(word)
                    continue
            if core.isascii() or max(core) < "ƀ" and unicodedata.is_normalized("NFC", core):
                whole.append((word, core, tail))
                if core not in known:
                    cores[core] = None
            else:
                single.append(word)
        if cores:
            if len(self.cores) + len(cores) > WORDS:
                self.cores.clear()
                cores = dict.fromkeys(core for _, core, _ in whole)
            self.cores.update(zip(cores, self.joined(list(cores)), strict=True))
        for word, core, tail in whole:
            self.words[word] = self.cores[core] + self.tails[tail] if tail else self.cores[core]
        self.words.update(zip(single, super().many(single), strict=True))

    def joined(self, cores: list[str]) -> list:
        encoding = self.plain.encode_batch_fast([" ".join(cores).translate(self.bytes)], add_special_tokens=False)[0]
        ids = np.array(encoding.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(cores):
            return _JsonEncoder.many(self, cores)
        if self.lengths:
            return np.diff(ends, prepend=0).tolist()
        data, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [data[a:b] for a, b in itertools.pairwise(at)]
