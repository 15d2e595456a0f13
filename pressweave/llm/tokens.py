"""Token ids of whole texts by a ``tokenizers`` file.

A worker keeps the ids of the words it has seen, in tables of bounded bytes, so the merge
model runs once per new word.  Words are cut by an expression that agrees with
the tokenizer's own on a checked set of characters; a text with any other
character, or with a special token in it, goes to the library as a whole.
"""
from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

from tokenizers import Tokenizer

LEARNT_BYTES = 128 << 20
ENTRY_BYTES = 240  # of a table's entry, beside the characters and the ids
LONG_WORD = 64

# The two cutting rules for which a quick equivalent is known, as the tokenizer files state them.
BYTE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LETTER, DIGIT, OTHER = r"[^\W\d_]", r"\d", r"(?:[^\s\w]|_)"
QUICK_BYTE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?{LETTER}+| ?{DIGIT}+| ?{OTHER}+|\s+(?!\S)|\s+")
WIDE_SPACES = ["  ", *(s for c in "\t\n\r" for s in (f" {c}", f"{c} "))]
QUICK_WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)|{LETTER}+|{DIGIT}|{OTHER}+")


def agreeing(char: str) -> bool:
    """Whether Python's expressions and Unicode's general categories class this character alike."""
    kind = unicodedata.category(char)
    if kind[0] in "CZ" and char not in " \t\n\r":
        return False
    return (bool(re.fullmatch(LETTER, char)) == (kind[0] == "L") and bool(re.fullmatch(DIGIT, char)) == (kind[0] == "N")
            and unicodedata.is_normalized("NFC", char) and len(char.lower()) == 1)


UNCHECKED = re.compile("[^" + "".join(re.escape(c) for c in map(chr, [*range(0x250), *range(0x2010, 0x2028), 0x20AC])
                                     if agreeing(c)) + "]")


def byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself and the others, in order, from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Learnt(dict):
    """Ids by word; an unknown word is worked out when it is first asked for.

    Long words are not kept.  A full table becomes the old one, which frequent words
    come back from, so at most twice ``limit`` bytes are held.
    """

    def __init__(self, work, limit: int):
        self.work, self.limit, self.held, self.old = work, limit, 0, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.work(word)
        if len(word) <= LONG_WORD:
            self.held += ENTRY_BYTES + len(word) + len(ids)
            if self.held > self.limit:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[word] = ids
        return ids

    def of(self, words) -> bytes:
        return b"".join(map(self.__getitem__, words))


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids as bytes, without added special tokens."""

    def __init__(self, path: str, learnt_bytes: int = LEARNT_BYTES):
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.model, self.alphabet = self.whole.model, byte_alphabet()
        spec = json.loads(self.whole.to_str())
        self.marks = [t["content"] for t in spec["added_tokens"]]
        rule = json.dumps([spec["normalizer"], spec["pre_tokenizer"], spec["model"].get("dropout")])
        byte_rule = json.dumps([None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None])
        word_rule = json.dumps([
            {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                                                 {"type": "Lowercase"}]},
            {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": WORD_RULE}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}, None])
        self.quick = {byte_rule: self.spaced, word_rule: self.folded}.get(rule)
        self.pieces = Learnt(self.piece, learnt_bytes)
        self.chunks = Learnt(lambda chunk: self.joined(QUICK_BYTE.findall(f" {chunk}")), learnt_bytes)
        self.words = Learnt(lambda word: self.joined(QUICK_WORD.findall(word)), learnt_bytes)

    def joined(self, parts: list[str]) -> bytes:
        """A word that is one piece is kept as a word alone."""
        return self.piece(parts[0]) if len(parts) == 1 else self.pieces.of(parts)

    def piece(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def spaced(self, text: str) -> bytes:
        """A space between two other characters always opens a piece, so what lies between such spaces stands alone."""
        if any(wide in text for wide in WIDE_SPACES):
            return self.pieces.of(QUICK_BYTE.findall(text))
        first, *rest = text.split(" ")
        return self.pieces.of(QUICK_BYTE.findall(first)) + self.chunks.of(rest)

    def folded(self, text: str) -> bytes:
        """White space is never part of a piece."""
        return self.words.of(text.lower().split())

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.quick is None or UNCHECKED.search(text) or any(m in text for m in self.marks):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return self.quick(text)


def encoder(path: str, learnt_bytes: int = LEARNT_BYTES) -> Encoder:
    """One encoder per worker process, with the words it has learnt."""
    kept = sys.modules[__name__].__dict__.setdefault("_kept", {})
    if (path, learnt_bytes) not in kept:
        kept.clear()
        kept[path, learnt_bytes] = Encoder(path, learnt_bytes)
    return kept[path, learnt_bytes]
