"""Words of a text as a word-BPE vocabulary file sees them.

The file's own steps are: NFC, white space to a space, lower case, then the pattern below; white space
is dropped. Text of code points below U+0300 is its own NFC and has no lower-casing by context, so
Python's functions do the same, but for two letters whose small ones lie above; any other text goes
through the library's normalizer.
"""

from __future__ import annotations

import re

import regex
from tokenizers import Tokenizer

WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOW = [chr(c) for c in range(0x300)]


def char_class(kind: str) -> str:
    return "".join(re.escape(c) for c in LOW if regex.match(kind, c))


LETTERS, NUMBERS, SPACES = (char_class(k) for k in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
ANY_WORD = regex.compile(WORD)
LOW_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
ANY_SPACE = regex.compile(r"\p{White_Space}+")
# U+023A and U+023E have lower-case letters beyond the classes above.
FAR = re.compile("[^\x00-\u02ff]|[\u023a\u023e]")


def split_at_spaces(text: str) -> list[str]:
    """The runs without white space: no step of the file looks across white space.

    Python also splits at the four separators U+001C to U+001F, which are ordinary characters here.
    """
    if SEPARATORS.search(text):
        return ANY_SPACE.sub(" ", text).split(" ") if text else []
    return text.split()


class Words:
    """Splits texts into words; strings of special tokens stay whole, as the library finds them."""

    def __init__(self, tokenizer_path: str):
        # The library's own tables are large and not kept: only its normalizer is asked again.
        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.normalizer = tokenizer.normalizer
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        found = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.split_special = re.compile(f"({'|'.join(found)})") if found else None

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            head, sign = text[:-1], text[-1:]
            if head.isalpha() and "!" <= sign <= "~" and not sign.isalnum():
                return [head.lower(), sign]
        if FAR.search(text):
            return ANY_WORD.findall(self.normalizer.normalize_str(text))
        return LOW_WORD.findall(text.lower())

    def __call__(self, text: str) -> list[str]:
        """Special tokens come as ``(content,)``, so no word can be mistaken for one."""
        if not self.split_special or "<|" not in text:
            return self.plain(text)
        words = []
        for k, part in enumerate(self.split_special.split(text)):
            words += [(part,)] if k % 2 else self.plain(part)
        return words
