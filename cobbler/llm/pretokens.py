"""Pre-tokens and counts for a byte-level BPE vocabulary file, checked against the tokenizers library.

A pre-token's count never depends on its surroundings, so a text's count is a sum over its pre-tokens.
Most vocabulary strings encode alone as one token: ``whole_tokens`` proves which, once, with the
library itself. Only other pre-tokens go through the library's merges, memoised per worker.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import groupby

from tokenizers import Tokenizer, pre_tokenizers

#: Pre-tokens remembered per worker before the memo is emptied (a bound on memory, not on the work).
MEMO = 150_000
#: Blocks in which the interpreter's character classes agree with the library's (tests/llm checks them);
#: a text with any other character is split by the library itself.
SURE = ((0x0, 0x1C7F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x3000, 0x303F),
        (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E))

# Unicode White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"


def _class(kind: str) -> str:
    """Character class body of the sure code points whose general category starts with ``kind``."""
    codes = [c for lo, hi in SURE for c in range(lo, hi + 1) if unicodedata.category(chr(c))[0] == kind]
    out = []
    for _, run in groupby(enumerate(codes), lambda p: p[1] - p[0]):
        run = [c for _, c in run]
        out.append(f"{re.escape(chr(run[0]))}-{re.escape(chr(run[-1]))}")
    return "".join(out)


@lru_cache(maxsize=1)
def _finders():
    letter, number = _class("L"), _class("N")
    split = re.compile(f"{CONTRACTION}| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+"
                       f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
    unsure = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z))}" for a, z in SURE) + "]").search
    return split, unsure, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str


def pretokens(text: str) -> list[str]:
    split, unsure, library = _finders()
    return [text[a:z] for _, (a, z) in library(text)] if unsure(text) else split(text)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode alone as exactly their own id (bounded by the file)."""
    tok = Tokenizer.from_file(path)
    back = {c: b for b, c in enumerate(byte_letters())}
    strings, ids = [], []
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        try:
            strings.append(bytes(back[c] for c in token).decode("utf-8"))
            ids.append(i)
        except (KeyError, UnicodeDecodeError):
            continue            # not a whole number of characters: no pre-token of a text equals it
    encoded = tok.encode_batch(strings, add_special_tokens=False)
    return sorted(s for s, i, e in zip(strings, ids, encoded) if e.ids == [i] and pretokens(s) == [s])


class Memo(dict):
    """Pre-token -> value: ``whole`` is known beforehand, other pre-tokens go through the library's merges once.

    Texts are split at the file's special strings first, as the library does by default.
    """

    def __init__(self, path: str, whole: dict):
        super().__init__(whole)
        tok = Tokenizer.from_file(path)
        self.whole, self.merge, self.letters = whole, tok.model.tokenize, byte_letters()
        special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        self.special_ids = special
        longest = sorted(special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if special else None

    def value(self, merged: list):
        raise NotImplementedError

    def __missing__(self, word: str):
        if len(self) > len(self.whole) + MEMO:
            self.clear()
            self.update(self.whole)
        letters = self.letters
        v = self[word] = self.value(self.merge("".join([letters[b] for b in word.encode()])))
        return v

    def parts(self, text: str) -> list[str]:
        """Plain stretches at even places, special strings between them."""
        return self.special.split(text) if self.special and self.special.search(text) else [text]


class Counts(Memo):
    """Token counts."""

    def value(self, merged: list) -> int:
        return len(merged)

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) // 2 + sum(sum(map(self.__getitem__, pretokens(p))) for p in parts[::2])


class Ids(Memo):
    """Token ids as little-endian unsigned 32-bit integers."""

    def value(self, merged: list) -> bytes:
        return b"".join(t.id.to_bytes(4, "little") for t in merged)

    def ids(self, text: str) -> bytes:
        out = []
        for k, p in enumerate(self.parts(text)):
            out += [self.special_ids[p].to_bytes(4, "little")] if k % 2 else map(self.__getitem__, pretokens(p))
        return b"".join(out)


@lru_cache(maxsize=1)
def counts(path: str, whole: tuple[str, ...]) -> Counts:
    return Counts(path, dict.fromkeys(whole, 1))


@lru_cache(maxsize=1)
def ids(path: str) -> Ids:
    return Ids(path, {})
