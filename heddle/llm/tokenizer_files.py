"""Tokenizer files of the tokenizers library: how they cut a text into pre-tokens, and their special strings.

Texts in Latin-1 are cut by Python's ``re``, with the character classes written out; any other text goes to the library's own
normalizer and pre-tokenizer, as their tables of Unicode properties may be of another version.
"""

from __future__ import annotations

import json
import re

from tokenizers import Tokenizer

#: Letters, numbers and white space of Latin-1, as \p{L}, \p{N} and \s have them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
BLANKS = "\\t-\\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

BYTE_LEVEL = re.compile(f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")
WORD_LEVEL = re.compile(f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")


def read(path: str) -> str:
    """The file's text. It is read once, on the driver; its size is the bound of what is broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def opened(text: str) -> Tokenizer:
    """The tokenizer of a file's text. A task opens it once and lets it go at its end."""
    return Tokenizer.from_str(text)


def parsed(text: str) -> dict:
    return json.loads(text)


def byte_signs() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


SIGNS = byte_signs()
TO_SIGNS = str.maketrans({chr(b): s for b, s in SIGNS.items()})
TO_BYTES = {s: b for b, s in SIGNS.items()}


def signs(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.replace(" ", SIGNS[0x20])
    return text.encode("utf-8", "replace").decode("latin-1").translate(TO_SIGNS)


def is_latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def opened_tokens(text: str) -> list[dict]:
    return parsed(text)["added_tokens"]


def specials(text: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Pattern and ids of the special strings, which a text is cut at first."""
    found = {t["content"]: t["id"] for t in opened_tokens(text)}
    return (re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None), found


class Cutter:
    """Cuts texts into pre-tokens written in byte signs, and special strings."""

    def __init__(self, text: str):
        self.tokenizer, (self.special, self.special_ids) = opened(text), specials(text)
        self.lower = self.tokenizer.normalizer is not None
        self.pattern = WORD_LEVEL if self.lower else BYTE_LEVEL
        self.cuts = 0

    def segment(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens of a text without special strings; whether they are still plain text, to be turned into signs."""
        if is_latin1(text):
            return self.pattern.findall(text.lower() if self.lower else text), True
        if self.lower:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [sign for sign, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)], False

    def segments(self, text: str):
        """(pre-tokens, plain, None) or ((), True, id of a special string), in the order of the text."""
        if self.special is None or not self.special.search(text):
            yield *self.segment(text), None
            return
        for part in self.special.split(text):
            if part in self.special_ids:
                yield (), True, self.special_ids[part]
            elif part:
                yield *self.segment(part), None
