"""Words of a text as the pre-token pieces of a tokenizers BPE file, and caches by word.

fits() tells whether a vocabulary is one of the kind that this module knows; others go
to the library by whole texts. Of that kind, the vocabulary's normalizer (NFC, white space, lower case) and pre-tokenizer (letters,
single digits, other signs, byte level) never look across ASCII white space, so a text's
tokens are those of its words `[^\\x20\\x09-\\x0D]+` in turn. Words below U+0250 are cut
here, one by one or many at once; others, and special strings, are left to the library.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import base

NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def plain(spec: dict) -> bool:
    """Whether the file is BPE by merges alone, its added tokens being found in the text as they are."""
    m = spec["model"]
    odd = m.get("dropout") or m.get("unk_token") or m.get("continuing_subword_prefix") or m.get("byte_fallback") or m.get("ignore_merges")
    return m["type"] == "BPE" and not odd and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))


def fits(spec: dict) -> bool:
    """Whether tokens of the vocabulary are those of a text's words, cut as here; added tokens start with '<|'."""
    return plain(spec) and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE and all(t["content"].startswith("<|") for t in spec["added_tokens"])


#: words and pieces that a worker remembers at most
MOST = 300_000


def _byte_chars() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


BYTE_CHARS = _byte_chars()
_TABLE = {b: c for b, c in enumerate(BYTE_CHARS) if chr(b) != c}
_LOWERED = sorted({x for c in range(0x250) for x in chr(c).lower()})
_L = "".join(re.escape(x) for x in _LOWERED if unicodedata.category(x)[0] == "L")
_N = "".join(re.escape(x) for x in _LOWERED if unicodedata.category(x)[0] == "N")
CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_L}{_N}]+").findall
#: characters that words cut here may not hold: beyond U+024F, or white space for the vocabulary
STRANGE = re.compile("[^\x00-ɏ]|[\x85\xa0]|<\\|").search


def cut(word: str) -> list[str] | None:
    """The word's byte-level pieces; None if the library has to tell them."""
    if word.isascii():
        return CUT(word.lower()) if "<|" not in word and word.isprintable() else None
    if STRANGE(word) or not word.isprintable():
        return None
    return byte_level(CUT(word.lower()))


def cut_text(word: str) -> list[str] | None:
    """The word's pieces as lower-case text; None if the library has to tell them."""
    return None if STRANGE(word) or not word.isprintable() else CUT(word.lower())


def byte_level(own: list[str]) -> list[str]:
    """Pieces from cut_text() in the characters that stand for their bytes."""
    return [p if p.isascii() else p.encode().decode("latin-1").translate(_TABLE) for p in own]


_LETTER, _NUMBER, _OTHER, _APART = range(4)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By character below U+0250, and one row for all others: kind, lower case, the latter's bytes of UTF-8."""
    kind, low = np.full(0x251, _APART, np.uint8), np.zeros(0x251, "<u2")
    for c in map(chr, range(0x250)):
        x = c.lower()
        if len(x) == 1 and c != "'" and c.isprintable() and not STRANGE(c):
            kind[ord(c)] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(x)[0], _OTHER)
            low[ord(c)] = ord(x)
    return kind, low, 1 + (low > 0x7F) + (low > 0x7FF)


_KIND, _LOW, _BYTES = _tables()


def cut_many(words: pa.StringArray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Which words are cut here; their pieces in turn, as cut_text() gives them; each one's number of pieces.

    Words (none empty, from base.strings()) with an apostrophe or anything that is strange are left out.
    """
    data = base.raw(words)[1].decode()
    chars = np.minimum(np.frombuffer(data.encode("utf-32-le"), "<u4"), 0x250)
    n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    kind, apart = _KIND[chars], np.zeros(len(n), bool)
    odd = kind == _APART
    odd[:-1] |= (chars[:-1] == ord("<")) & (chars[1:] == ord("|"))
    if odd.any():
        apart[np.searchsorted(np.cumsum(n), np.flatnonzero(odd), "right")] = True
        keep = np.repeat(~apart, n)
        chars, kind, n = chars[keep], kind[keep], n[~apart]
    if not len(n):
        return ~apart, pa.array([], pa.string()), n
    begins, first = np.ones(len(kind), bool), np.cumsum(n) - n
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    begins[first] = True
    at = base.starts_of(_BYTES[chars])
    at = np.append(at[:-1][begins], at[-1]).astype(np.int32)
    text = _LOW[chars].tobytes().decode("utf-16-le").encode()
    return ~apart, pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(text)), np.add.reduceat(begins, first, dtype=np.int64)
