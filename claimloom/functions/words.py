"""Words of a text, as every operator on words reads them.

A word is a maximal run of letters and digits after NFKC and case folding; a
point between two digits and a minus directly before a digit, with no letter
or digit before it, belong to the word. A null text has no words.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

_WORD = re.compile(r"(?:(?<![^\W_])-(?=\d))?[^\W_]+(?:(?<=\d)\.(?=\d)[^\W_]+)*")


def folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def words(text: str | None) -> list[str]:
    """The words of a text in order."""
    if not text:
        return []
    out: list[str] = []
    add, more, find = out.append, out.extend, _WORD.findall
    for run in folded(text).split():
        if run.isalnum():
            add(run)
        else:
            more(find(run))
    return out


def words_digest(text: str | None) -> bytes:
    """128 bits that are the same for texts with the same words in the same order."""
    return hashlib.blake2b(" ".join(words(text)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
