"""Encoding with the tokenizers library, each distinct word once per worker.

Both vocabularies cut a text into pieces before merging, and no piece spans the cuts made here, so the ids of a
text are the ids of its words in a row. Words found before are looked up; the memo is bounded and only saves
work, never changes ids.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from .common import hold

MEMO_WORDS = 500_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters and then ASCII punctuation other than the apostrophe, which starts pieces of its own.
SIMPLE = re.compile(rf"( ?[{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")
LINES = re.compile(r" ?[^\s]+(?:\n[^\s]+)+")
#: A space inside a run of white space that isn't the run's last sign before a word: there the byte-level
#: pieces depend on the whole run.
RUN = re.compile(r"\s (?:\s|\Z)")


def byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Memo:
    """A bounded map: when the young half is full it becomes the old half, and what is used again moves back."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def again(self, key: str) -> bytes | None:
        got = self.old.get(key)
        return None if got is None else self.put(key, got)


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids as bytes, equal to
    Tokenizer.encode(text, add_special_tokens=False).ids without truncation and padding.

    The word memo serves the two layouts named below; for any other tokenizer each text is encoded whole.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        own = not any(re.search(r"\s", s) for s in self.special) and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        self.kind = "whole"
        if own and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
                self.kind = "byte"
            elif spec["model"].get("end_of_word_suffix") and norm and [n["type"] for n in norm.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and pre.get("type") == "Sequence" and [p["type"] for p in pre["pretokenizers"]] == ["Split", "ByteLevel"]:
                self.kind = "word"
        self.signs, self.model = byte_signs(), self.tok.model
        self.memo, self.heads = Memo(MEMO_WORDS), Memo(MEMO_WORDS // 8)
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, letters: str) -> bytes:
        """One piece for the merges: letters with at most one leading space, or punctuation."""
        signs = letters.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def bare(self, letters: str) -> bytes:
        """A part of a chunk, through the memo; a word's key has no leading space."""
        key = letters.removeprefix(" ") if letters[0] == " " else f" {letters}"
        if self.kind == "word":
            key = letters
        got = self.memo.young.get(key)
        if got is None:
            got = self.memo.again(key)
        return self.memo.put(key, self.part(letters.lower() if self.kind == "word" else letters)) if got is None else got

    def piece(self, chunk: str) -> bytes:
        """A chunk between cuts."""
        if m := SIMPLE.fullmatch(chunk):
            letters, marks = m.groups()
            if marks:
                return self.bare(letters) + self.bare(marks)
            return self.part(letters.lower() if self.kind == "word" else letters)
        if self.kind == "byte" and LINES.fullmatch(chunk):
            return self.line.join(self.piece(x) for x in chunk.split("\n"))
        return self.whole(chunk)

    def ids(self, text: str) -> bytes:
        if self.kind == "word":
            words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            return self.joined(words, "")
        if self.kind == "byte" and not RUN.search(text) and not any(s in text for s in self.special):
            head, *words = text.split(" ")
            got = self.heads.young.get(head)
            if got is None:
                got = self.heads.put(head, self.piece(head) if head else b"")
            return got + self.joined(words, " ")
        return self.whole(text)

    def joined(self, words: list[str], lead: str) -> bytes:
        out = list(map(self.memo.young.get, words))
        if None in out:
            memo = self.memo
            for k, got in enumerate(out):
                if got is None:
                    w = words[k]
                    got = memo.young.get(w)
                    if got is None:
                        got = memo.again(w)
                    if got is None:
                        got = memo.put(w, self.piece(lead + w) if lead + w else b"")
                    out[k] = got
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, kept between tasks."""
    return hold(("encoder", path), lambda: Encoder(path))
