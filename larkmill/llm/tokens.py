"""Token ids by a public tokenizer. Where it never joins text across white space, Arrow numbers the words of many texts, each different
word is cut into runs once, and only runs that aren't in a cache go to the tokenizer."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries a cache holds before its older half goes; this bounds memory and changes no result.
CACHE_ENTRIES = 250_000
#: Longest words that are cut into runs, and longest keys that are kept.
LONGEST = 64
#: Bytes of plain words: 1 letters a-z, 2 ASCII signs without the apostrophe.
_KIND = np.array([1 if 97 <= b <= 122 else 2 if 33 <= b <= 126 and b != 39 and not chr(b).isalnum() else 0 for b in range(256)], dtype=np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Letters that NFC and lower-casing leave alone, or ASCII signs without apostrophes.
_RUN = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+")

#: How byte-level models spell bytes: printable Latin-1 as it is, the others from U+0100 on.
_SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_loaded: dict[str, "Encoder"] = {}
assert array("I").itemsize == 4 and sys.byteorder == "little"


def encoder(path: str) -> "Encoder":
    """One encoder for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class _Recent:
    """The last CACHE_ENTRIES to twice as many results of a function: when full, the older half goes."""

    def __init__(self, make):
        self.make, self.new, self.older = make, {}, {}

    def all(self, keys: list[str]) -> list[bytes]:
        got = list(map(self.new.get, keys))
        new, older, make = self.new, self.older, self.make
        for i in [i for i, v in enumerate(got) if v is None]:
            key = keys[i]
            v = older.get(key)
            got[i] = v = make(key) if v is None else v
            if len(key) <= LONGEST:
                if len(new) >= CACHE_ENTRIES:
                    new, older = {}, new
                new[key] = v
        self.new, self.older = new, older
        return got


class Encoder:
    """The ids of texts, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = _drops_white_space(spec)
        self.known = _Recent(self._ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit bytes."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has. `end`, ids as bytes, follows each text."""
        if not self.by_word:
            blobs = [(self.whole(t) if t else b"") + end for t in texts.to_pylist()]
            return np.frombuffer(bytearray().join(blobs), dtype="<u4"), np.array([len(b) // 4 for b in blobs], dtype=np.int64)
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        last = np.cumsum(pc.list_value_length(words).to_numpy(), dtype=np.int64)
        coded = words.flatten().dictionary_encode()
        del words
        ids = pa.concat_arrays([self._words(coded.dictionary), pa.array([end], pa.large_binary())])
        at = np.insert(coded.indices.to_numpy(), last, len(ids) - 1)
        bounds, data = _parts(ids.take(pa.array(at)))
        ends = bounds[last + np.arange(1, len(last) + 1)]
        return data.view("<u4"), np.diff(ends, prepend=0) // 4

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of each word. A plain word, letters up to U+00FF and then ASCII signs, is lower-cased and cut after its letters: the
        tokenizer cuts there too. Any other is one piece as it stands."""
        bounds, data = _parts(words)
        size, low = np.diff(bounds), _LOWER[data]
        kind = _KIND[low]
        at = np.flatnonzero(data[:-1] == 0xC3) + 1  # second bytes of U+00C0 to U+00FF
        if len(at):
            second = low[at]
            low[at] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
            kind[at] = kind[at - 1] = (second >= 0x80) & (second != 0x97) & (second != 0xB7)
        seen, signs = (np.cumsum(np.append(False, kind == k), dtype=np.int64) for k in (1, 2))
        letters, signs = np.diff(seen[bounds]), np.diff(signs[bounds])
        plain = (letters > 0) & (letters + signs == size) & (size <= LONGEST) & (seen[bounds[:-1] + letters] == seen[bounds[1:]])
        cuts = np.repeat(bounds, 2)[:-1]
        cuts[1::2] += np.where(plain, letters, size)
        low = np.where(np.repeat(plain, size), low, data)
        coded = _array(pa.large_string(), cuts, low).dictionary_encode()
        ids = pa.array(self.known.all(coded.dictionary.to_pylist()), pa.large_binary())
        bounds, data = _parts(ids.take(coded.indices))
        return _array(pa.large_binary(), bounds[::2], data)

    def _ids(self, piece: str) -> bytes:
        """A run that normalising leaves alone and splitting leaves whole goes to the tokenizer's model as it is, in its spelling of bytes."""
        if not _RUN.fullmatch(piece):
            return self.whole(piece)
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SPELLED)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()


def _parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a string or binary array begin and end, and their bytes, from 0 on."""
    if not len(a):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = a.type in (pa.large_string(), pa.large_binary())
    bounds = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32, len(a) + 1, a.offset * (8 if wide else 4)).astype(np.int64, copy=False)
    data = np.frombuffer(a.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, dtype=np.uint8)
    return bounds - bounds[0] if bounds[0] else bounds, data


def _array(kind: pa.DataType, bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data)])


def _drops_white_space(spec: dict) -> bool:
    """Whether ids of a text are those of its words one after the other: white space becomes a blank, is dropped before the model,
    and no added token holds or strips white space."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    blanks = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    known = all(s.get("type") in ("NFC", "Lowercase", "Replace") for s in steps)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "")
    added = all(not (a.get("lstrip") or a.get("rstrip") or a.get("single_word") or re.search(r"\s", a["content"])) for a in spec.get("added_tokens", []))
    return bool(blanks and known and drops and added and not spec.get("post_processor"))
