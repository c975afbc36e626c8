"""Token ids from a public tokenizer file, worked out once per distinct word.

Pre-tokenization never joins text across a blank that precedes a visible character, so a text can be
encoded blank by blank and the ids concatenated. A block of texts is split and its words are numbered
in Arrow; each distinct word is looked up in a bounded cache or goes through the tokenizer's own
model, and the ids are gathered by word number. Two pre-tokenizer settings (byte-level, and words with
blanks removed) are split here, since the library's per-call cost is many times that of a word; any
other setting, and any text that holds one of the tokenizer's added tokens, goes through the library's
``encode`` whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Words kept per worker (about 200 bytes each), and a quarter as many parts of words with marks; later ones are encoded each time.
CACHE_ENTRIES = 400_000
#: Longer words are encoded each time and not kept.
CACHE_CHARS = 64
#: Bytes of text that are encoded together (one text at least).
BLOCK_BYTES = 4 << 20

#: The split pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Printable Latin-1 characters stand for themselves, other bytes for those from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Marks that end words; a run of them is one piece under either pattern.
MARKS = ".,;:!?*$%&#|<>()-"

#: A blank that is followed by another one or by the end: not a place to cut.
ODD_BLANK = re.compile(r" (?=\s|$)")

#: From here on libraries differ in what is a letter; such words go through the library whole.
BEYOND = "ɐ"

_LETTERS = _byte_letters()

_WORKER: dict[str, "Encoder"] = {}


def worker_encoder(path: str) -> "Encoder":
    """One encoder per Python worker and file."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


class _Cache(dict):
    def __init__(self, fill, most: int):
        super().__init__()
        self.fill, self.most = fill, most

    def __missing__(self, key):
        value = self.fill(key)
        if len(key) <= CACHE_CHARS and len(self) < self.most:
            self[key] = value
        return value


class Encoder:
    """``blocks`` and ``encode`` give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``;
    ``encode`` as little-endian bytes, ``width`` bytes an id (2 where the vocabulary fits, else 4)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        if sys.byteorder != "little" or array(self.code).itemsize != self.width:
            raise OSError("ids are written as little-endian arrays of 2 or 4 bytes")
        added = [t["content"] for t in spec.get("added_tokens") or []]
        #: Finds every added token, in any case: normalization may come before the library's own search.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        pattern = str((steps[0].get("pattern") or {}).get("Regex"))
        self.lead = self.split = None
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and self.normalizer is None:
            self.lead, self.split = " ", regex.compile(BYTE_LEVEL)
        elif len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and pattern.endswith(r"[^\s\p{L}\p{N}]+") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space"):
            self.lead, self.split = "", regex.compile(pattern)
        self.later = _Cache(lambda part: self._chunk(self.lead + part, len(self.lead)), CACHE_ENTRIES)
        self.pieces = _Cache(self._piece, CACHE_ENTRIES // 4)

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(_LETTERS) if not (piece.isascii() and piece.isalnum()) else piece
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def _chunk(self, chunk: str, lead: int) -> bytes:
        if not chunk.isascii() and max(chunk) >= BEYOND:
            return self._whole(chunk)
        if self.normalizer is not None:
            chunk = chunk.lower() if chunk.isascii() else self.normalizer.normalize_str(chunk)
        word = chunk.rstrip(MARKS)
        if word[lead:].isalpha():  # a word and perhaps marks: two pieces, found without the pattern
            return self._piece(word) if len(word) == len(chunk) else self.pieces[word] + self.pieces[chunk[len(word) :]]
        return b"".join([self.pieces[p] for p in self.split.findall(chunk)])

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _odd(self, text: str) -> bool:
        """Whether a text goes through the library as it stands."""
        return self.lead is None or bool(self.lead and ODD_BLANK.search(text)) or bool(self.added and self.added.search(text))

    def encode(self, text: str) -> bytes:
        """One text."""
        if not text:
            return b""
        if self._odd(text):
            return self._whole(text)
        head, *parts = text.split(" ")
        return (self._chunk(head, 0) if head else b"") + b"".join([self.later[p] for p in parts])

    def _stems(self, words: np.ndarray) -> list[bytes]:
        """The ids of distinct words that follow a blank, each as one chunk."""
        kept, room, tokenize, lead = self.later, CACHE_ENTRIES - len(self.later), self.model.tokenize, _LETTERS[32] if self.lead else ""
        out, lower = list(map(kept.get, words)), self.normalizer is not None
        for k in [k for k, known in enumerate(out) if known is None]:
            w = words[k]
            if w.isascii() and w.isalpha():
                out[k] = value = array(self.code, [t.id for t in tokenize(lead + (w.lower() if lower else w))]).tobytes()
            elif not lower and w.isalpha() and max(w) < BEYOND:
                out[k] = value = array(self.code, [t.id for t in tokenize(lead + w.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
            else:
                out[k] = value = self._chunk(self.lead + w, len(self.lead))
            if room > 0 and len(w) <= CACHE_CHARS:
                kept[w] = value
                room -= 1
        return out

    def _fill(self, words: pa.Array, distinct: np.ndarray) -> list[bytes]:
        """The ids of distinct words that follow a blank. Marks at a word's end are a piece of their own
        where a letter or digit stands before them, so that a word is looked up without them."""
        bare = pc.ascii_rtrim(words, MARKS)
        stems = bare.dictionary_encode()
        names, at = stems.dictionary.to_numpy(zero_copy_only=False), stems.indices.to_numpy()
        found = self._stems(names)
        out = list(map(found.__getitem__, at.tolist()))
        for k in np.flatnonzero(pc.binary_length(bare).to_numpy() < pc.binary_length(words).to_numpy()).tolist():
            word, stem = distinct[k], names[at[k]]
            if stem and stem[-1] < BEYOND and stem[-1].isalnum():
                out[k] += self.pieces[word[len(stem) :]]
            else:
                out[k] = self.later[word]
        return out

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many are of each."""
        values = texts.to_numpy(zero_copy_only=False)
        if any(map(self._odd, values)):
            found = [np.frombuffer(self.encode(t), self.kind) for t in values]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        begin = np.asarray(split.offsets)[:-1] - split.offsets[0].as_py()
        at = words.indices.to_numpy().astype(np.int64)
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        known = self._fill(words.dictionary, distinct)
        heads = distinct[at[begin]]
        at[begin] = len(known) + np.arange(len(begin))
        known += [self._chunk(h, 0) if h else b"" for h in heads]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        flat, starts = np.frombuffer(b"".join(known), self.kind), np.cumsum(sizes) - sizes
        lengths = sizes[at]
        shift = starts[at] - (np.cumsum(lengths) - lengths)
        return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))], np.add.reduceat(lengths, begin)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per block of successive texts (null: empty) the first one's number, the ids of all of them and how
        many are of each."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
        at = 0
        while at < len(texts):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, "right")))
            yield at, *self._block(texts.slice(at, to - at))
            at = to


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several documents with an end id after each."""
    return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
