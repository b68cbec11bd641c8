"""Token ids of whole texts by a public tokenizer file.

``Encoder`` gives exactly what ``Tokenizer.encode(text, add_special_tokens=
False)`` gives for tokenizers that drop white space and never look across it,
but encodes each distinct word once: texts are cut at blanks and line feeds, a
word of plain letters with punctuation around it falls into up to three parts
that the tokenizer's own splitting would form, and everything else goes to the
tokenizer as it stands. Words are remembered within a fixed number of entries.
Whether a tokenizer is of that kind is tried on fixed texts; one that is not
gets whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import compress, islice, repeat
from operator import is_

import numpy as np

#: ASCII punctuation that is one run for the tokenizer; without signs of contractions and special tokens.
_PUNCTUATION = '.,;:!?"()[]{}*#$%&+-=/\\@^_~`'
#: Characters whose lower case or normal form may depend on what stands around them, or may end in a mark that joins the sign behind it.
_WIDE = re.compile("[\u0130\u0250-\U0010ffff]")
#: A full stop or comma that belongs to a longer run of signs, or may do so.
_RUN = re.compile("[^\\w ][.,] |[_\u0130\u0250-\U0010ffff][.,] ")
#: Texts by which a tokenizer is tried: case, white space, punctuation, contractions, marks, digits, controls.
_PROBES = (
    "Plain words, and More of them. The end.", "A  b\tc\n d\r\ne ", "it's we'll I'd 'tis x' 's", "(a) [b], {c}... d--e f.g,h 1,000.5 a1b2",
    "Stra\u00dfe \u0130I, \u0130. \ufb01n \u017fo \u00c9t\u00e9 e\u0301t\u0301 \ufb1d, \u00a0x\u2028y", "<|endoftext|> a<|b", "\x00a \x1f, _b_. __, ", "",
)
_JOIN = 256
_LONGEST = 64


def _letters_only(word: str) -> bool:
    return word.isalpha() and (word.isascii() or not _WIDE.search(word))


def _kinds() -> bytes:
    """Kind of each Latin-1 character: letter or digit, blank, stop or comma, any other."""
    kinds = bytearray(b"!" * 256)
    for i in range(256):
        if chr(i).isalnum():
            kinds[i] = ord("a")
    kinds[ord(" ")] = ord(" ")
    kinds[ord(".")] = kinds[ord(",")] = ord(".")
    return bytes(kinds)


_KIND = _kinds()


def _chunks(text: str) -> list[str]:
    """Parts of a text that can be encoded one by one; lower-cased and cut from stops and commas where that changes nothing."""
    text = text.replace("\n", " ")
    try:
        kinds, wide = text.encode("latin-1").translate(_KIND), False
        run = b"!. " in kinds or b".. " in kinds
    except UnicodeEncodeError:
        wide, run = _WIDE.search(text), _RUN.search(text)
    if not wide and "<|" not in text:
        text = text.lower()
    if not run:
        text = text.replace(", ", " , ").replace(". ", " . ")
    return text.split(" ")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    _made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, entries: int):
        # Spark runs a task per core: threads of the library would only get in each other's way
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.bare = self._bare(path)
        self.entries = entries
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}
        self.by_words = True
        self.by_words = self.encode(list(_PROBES)) == self._each(list(_PROBES))

    def _bare(self, path: str):
        """The same vocabulary and merges without normalizing and splitting, for words of a-z; None where that is not the same."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer.from_file(path)
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        some = [t.removesuffix("</w>") for t in self.tokenizer.get_vocab()]
        line = " ".join([t for t in some if t.isascii() and t.isalpha() and t.islower()][:2000] + list("abcdefghijklmnopqrstuvwxyz"))
        same = bare.encode(line, add_special_tokens=False).ids == self.tokenizer.encode(line, add_special_tokens=False).ids
        return bare if same else None

    @classmethod
    def of(cls, path: str, entries: int = 500_000) -> Encoder:
        """The encoder of this worker process; its memory lasts over tasks."""
        key = (path, entries)
        if key not in cls._made:
            cls._made[key] = cls(path, entries)
        return cls._made[key]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return self._each([t or "" for t in texts])
        cut = [_chunks(t or "") for t in texts]
        for memory in (self.words, self.parts):
            if len(memory) > self.entries:
                for w in list(islice(memory, 1, len(memory) - self.entries // 2)):
                    del memory[w]
        found = [list(map(self.words.get, ws)) for ws in cut]
        gaps = [list(compress(range(len(ws)), map(is_, ids, repeat(None)))) for ws, ids in zip(cut, found, strict=True)]
        unknown = {ws[i] for ws, at in zip(cut, gaps, strict=True) for i in at}
        local = self._learn(unknown) if unknown else {}
        for ws, ids, at in zip(cut, found, gaps, strict=True):
            for i in at:
                ids[i] = local[ws[i]] if ws[i] in local else self.words[ws[i]]
        return [b"".join(ids) for ids in found]

    def _learn(self, unknown: set[str]) -> dict[str, bytes]:
        """Adds words to the memory; returns those too long to be kept."""
        whole, split, plain = [], [], []
        for w in unknown:
            if len(w) > _LONGEST:
                whole.append(w)
            elif _letters_only(w):
                plain.append(w)
            else:
                tail = w.rstrip(_PUNCTUATION)
                core = tail.lstrip(_PUNCTUATION)
                if not core or _letters_only(core):
                    split.append((w, tail[: len(tail) - len(core)], core, w[len(tail) :]))
                else:
                    whole.append(w)
        self._letters(plain, self.words)
        have = self.parts
        self._letters({k for _, _, k, _ in split if k not in have}, have)
        signs = {s for _, head, _, end in split for s in (head, end) if s not in have}
        for s, ids in zip(signs, self._each(list(signs)), strict=True):
            have[s] = ids
        for w, head, key, end in split:
            self.words[w] = have[head] + have[key] + have[end]
        local = {}
        for w, ids in zip(whole, self._each(whole), strict=True):
            (self.words if len(w) <= _LONGEST else local)[w] = ids
        return local

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _letters(self, words: Iterable[str], memory: dict[str, bytes]) -> None:
        """Runs of letters, many at a time: each ends with the one token that ends a word."""
        order = sorted(words)
        simple = [w for w in order if w.isascii() and w.islower()] if self.bare else []
        self._joined(self.bare, simple, memory)
        self._joined(self.tokenizer, [w for w in order if not (w.isascii() and w.islower())] if self.bare else order, memory)

    def _joined(self, tokenizer, order: list[str], memory: dict[str, bytes]) -> None:
        groups = [order[i : i + _JOIN] for i in range(0, len(order), _JOIN)]
        found = tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) if groups else []
        for group, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(group):
                data, last = ids.tobytes(), 0
                for w, stop in zip(group, stops, strict=True):
                    memory[w] = data[4 * last : 4 * stop]
                    last = stop
            else:
                for w, one in zip(group, self._each(group), strict=True):
                    memory[w] = one


def text_groups(texts: list[str | None], limit: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` characters."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            out.append((begin, i + 1))
            begin, size = i + 1, 0
    if begin < len(texts):
        out.append((begin, len(texts)))
    return out
