"""Encoding with a public tokenizer: whole texts, with a bounded cache of the words met."""

from __future__ import annotations

import os
import sys
from array import array
from itertools import islice

#: Entries of a cache generation, three times as many where capitals and spaces make more forms of a word; two are held.
CACHE_WORDS = 200_000
#: Characters of a word that a cache keeps: longer ones (encoded data, say) hardly come again.
LONGEST = 48
TAIL = ".,;:!?"


def byte_letters() -> dict[str, str]:
    """The printable stand-in for each byte in byte-level BPE: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): chr(b) for b in own} | {chr(b): chr(256 + k) for k, b in enumerate(rest)}


def letter_bytes() -> dict[str, int]:
    """The byte that each printable stand-in of byte-level BPE stands for."""
    return {stand_in: ord(own) for own, stand_in in byte_letters().items()}


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit little-endian bytes."""
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def lowered(text: str) -> str:
    """In lower case if every character is below 256, where lower case is a matter of single characters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class _Unsafe(Exception):
    """White space that a cut would tear apart; the text is encoded in one piece instead."""


class _Cache(dict):
    """Ids (32-bit, little-endian) by word. When full, its words become the old generation."""

    def __init__(self, make, times: int = 1):
        super().__init__()
        self.make, self.old, self.times = make, {}, times

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) > LONGEST:
            return got
        if len(self) >= self.times * CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Encoder:
    """ids(text): the same ids as Tokenizer.encode(text, add_special_tokens=False), as 32-bit bytes.

    Both kinds of tokenizer (byte-level BPE, and BPE with word ends that drops white space) never merge across
    a space or line end that stands between two other characters, so texts are cut there and each word is
    encoded once while it stays in the cache. Texts with special tokens or runs of white space that a cut
    would change are encoded in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        about = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in about["added_tokens"]]
        kinds = str(about["pre_tokenizer"])
        self.byte_level = about["pre_tokenizer"]["type"] == "ByteLevel" and about["pre_tokenizer"]["use_regex"] and not about["pre_tokenizer"]["add_prefix_space"] and about["normalizer"] is None
        self.words_only = about["normalizer"] is not None and "Lowercase" in str(about["normalizer"]) and "Removed" in kinds
        self.letters = str.maketrans(byte_letters())
        self.model = self.tokenizer.model
        self.tails = _Cache(self.library)
        self.units = {lead: _Cache(lambda unit, lead=lead: self._unit(lead, unit), 3 if self.byte_level else 1) for lead in ("", " ", "\n")}

    def library(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, lead: str, word: str) -> bytes:
        """Of letters alone, which the model takes as one piece."""
        if self.words_only:
            word, lead = word.lower(), ""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(self.letters[32] + word if lead else word)])

    def _unit(self, lead: str, unit: str) -> bytes:
        if self.words_only:
            lead = ""
        elif not unit or unit[0].isspace() or unit[-1].isspace():
            raise _Unsafe
        core = unit.rstrip(TAIL)
        if core and (core.isascii() or max(core) < "ƀ") and core.isalpha() and core.lower().isalpha():
            if lead == "\n":
                return self.tails["\n"] + self.units[""][unit]
            if len(core) < len(unit):
                return self.units[lead][core] + self.tails[unit[len(core) :]]
            return self._word(lead, core)
        return self.library(lead + unit)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or not (self.byte_level or self.words_only):
            return self.library(text)
        if self.words_only:
            return b"".join(map(self.units[""].__getitem__, lowered(text).replace("\n", " ").split(" ")))
        try:
            first, *rest = text.split("\n")
            bare, spaced, newline = self.units[""], self.units[" "].__getitem__, self.units["\n"]
            parts = first.split(" ")
            out = [bare[parts[0]], *map(spaced, islice(parts, 1, None))]
            for line in rest:
                parts = line.split(" ")
                out.append(newline[parts[0]])
                out += map(spaced, islice(parts, 1, None))
            return b"".join(out)
        except _Unsafe:
            return self.library(text)


_HELD: dict[str, Encoder] = {}


def release() -> None:
    """Drops the encoder that this worker keeps."""
    _HELD.clear()


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept for the next task of the same worker."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Encoder(path)
    return _HELD[path]


#: Fixed value: how byte-level BPE cuts texts into words.
WORDS_OF_BYTES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """ids(text): the same ids as Tokenizer.encode of a byte-level BPE file, special tokens in the text being plain text.

    Where the ids of entries follow the order of merges, as they do in files that were trained in one go, merging by the id of the
    result is the same, which another library does several times as fast.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        model, special = about["model"], {t["content"] for t in about["added_tokens"]}
        letters = letter_bytes()
        self.entries = {bytes(map(letters.__getitem__, entry)): number for entry, number in model["vocab"].items() if entry not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or not about["pre_tokenizer"]["use_regex"] or about["pre_tokenizer"]["add_prefix_space"] or about["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        self.own = tiktoken.Encoding("bytes", pat_str=WORDS_OF_BYTES, mergeable_ranks=self.entries, special_tokens={})

    def pieces(self) -> list[bytes]:
        """The bytes that each id stands for; of special tokens none."""
        out = [b""] * (max(self.entries.values()) + 1)
        for entry, number in self.entries.items():
            out[number] = entry
        return out

    def ids(self, text: str) -> list[int] | None:
        """The ids, or None where they do not spell the text."""
        out = self.own.encode_ordinary(text)
        return out if self.own.decode_bytes(out) == text.encode("utf-8", "surrogatepass") else None


class PieceEncoder:
    """ids(text): the same ids as SentencePieceProcessor.encode(text)."""

    SPACE = "\u2581"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        self.spelt = self.pieces()

    def pieces(self) -> list[bytes]:
        """The bytes that each id stands for."""
        names = map(self.own.id_to_piece, range(self.own.get_piece_size()))
        return [bytes([int(name[3:5], 16)]) if self.own.is_byte(k) else name.replace(self.SPACE, " ").encode() for k, name in enumerate(names)]

    def ids(self, text: str) -> list[int] | None:
        """The ids, or None where they do not spell a space and the text."""
        out = self.own.encode(text, num_threads=1)
        return out if b"".join(map(self.spelt.__getitem__, out)) == (" " + text).encode("utf-8", "surrogatepass") else None
