"""Ids of whole texts as the tokenizers library gives them, by the units between spaces, with bounded caches.

For two kinds of vocabulary the ids of a text are the ids of its units in order, where a
unit is what stands between two spaces (byte-level: with the space before it), so long as
no unit is empty or begins or ends with white space; a text with such a unit, or with an
added token such as <|endoftext|>, is encoded as a whole. So is every text under any other
kind of vocabulary, which its file tells. Most units come from a cache. A new unit of ASCII and Latin-1
letters is cut by the tokenizer's own pattern and its pieces go to the tokenizer's BPE
model; any other unit goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import sys
from array import array

import regex

#: Units of a generation (two are kept) and pieces kept by one Python worker; others are encoded each time they come.
CACHE_UNITS, CACHE_PIECES, CACHE_CHARS = 600_000, 100_000, 48
#: The patterns by which the two vocabularies cut text.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Text in which all Unicode versions agree on letters, case and normal form.
PLAIN = regex.compile(r"[\t\n\r\x21-\x7E¡-ÿ]*").fullmatch


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it: printable Latin-1 as it is, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Known(dict):
    """A dict that asks `new` for what it lacks."""

    def __init__(self, new):
        super().__init__()
        self.new = new

    def __missing__(self, key):
        return self.new(key)


def kind(spec: dict) -> str:
    """Which way a vocabulary file cuts text: "spaced" (a space belongs to the unit after it), "folded" (spaces have no ids and case folds), or "other"."""
    model, added = spec.get("model") or {}, spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or any(t.get("normalized") or not t["content"] for t in added):
        return "other"
    cut, norm, suffix = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), model.get("end_of_word_suffix")
    if cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex") and norm is None and not suffix:
        return "spaced"
    steps, parts = (norm or {}).get("normalizers", []), cut.get("pretokenizers", [])
    if [x.get("type") for x in steps] != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"]:
        return "other"
    spaces = steps[1].get("pattern") == {"Regex": "\\s+"} and steps[1].get("content") == " "
    split = parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[0].get("behavior") == "Removed" and parts[0].get("invert")
    return "folded" if spaces and split and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex") else "other"


class UnitEncoder:
    """ids(texts) -> for each text the bytes of its ids as little-endian uint32."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        spec = json.loads(tokenizer_json)
        found = kind(spec)
        self.spaced, self.whole = found == "spaced", found == "other"
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.find = regex.compile(BYTE_PATTERN if self.spaced else WORD_PATTERN).findall
        self.letters = byte_letters()
        self.units, self.pieces = Known(self._unit), Known(self._piece)
        #: Units that came in the generation before: what comes again moves on, the rest is forgotten.
        self.older: dict[str, bytes] = {}
        self.odd = False

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _model(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.model.tokenize(spelled)])

    def _piece(self, piece: str) -> bytes:
        out = self._model(piece)
        if len(self.pieces) < CACHE_PIECES and len(piece) <= CACHE_CHARS:
            self.pieces[piece] = out
        return out

    def _unit(self, unit: str) -> bytes:
        if self.spaced and (not unit or unit[0].isspace() or unit[-1].isspace()):
            self.odd = True
            return b""
        out = self.older.get(unit)
        if out is None:
            out = self._new_unit(unit)
        if len(unit) <= CACHE_CHARS:
            if len(self.units) >= CACHE_UNITS:
                self.older, self.units = self.units, Known(self._unit)
            self.units[unit] = out
        return out

    def _new_unit(self, unit: str) -> bytes:
        text = " " + unit if self.spaced else unit
        if not PLAIN(unit):
            return self._whole(text)
        if not self.spaced:
            text = text.lower()
        if unit.isalpha():
            return self._model(text)  # one piece
        if unit[:-1].isalpha() and unit[-1] in ".,;:!?":
            return self.units[unit[:-1]] + self.pieces[unit[-1]]  # two of them
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        found = self.find(text)
        return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def one(self, text: str) -> bytes:
        if self.whole or any(a in text for a in self.added):
            return self._whole(text)
        units = text.split(" ")
        if not self.spaced:
            return b"".join(map(self.units.__getitem__, units))
        head = units.pop(0)
        if units and head[-1:].isspace():
            return self._whole(text)
        self.odd = False
        got = b"".join(map(self.units.__getitem__, units))
        if self.odd:
            return self._whole(text)
        return (self._plain(head) if PLAIN(head) else self._whole(head)) + got if head else got

    def ids(self, texts: list[str]) -> list[bytes]:
        return list(map(self.one, texts))


_encoders: dict[str, UnitEncoder] = {}


def encoder(tokenizer_file: str, tokenizer_json: str) -> UnitEncoder:
    """One encoder for each vocabulary and Python worker; it outlives a task."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = UnitEncoder(tokenizer_json)
    return _encoders[tokenizer_file]
