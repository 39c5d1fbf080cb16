"""Encoding texts with a tokenizer file of the ``tokenizers`` library, each distinct pre-token once per worker.

The library encodes about 0.8 MB of text a second and core. Its pre-tokenizer makes the pieces of a
text independent of each other, so every distinct piece goes through the library once and is kept;
texts become look-ups. In texts of plain Latin letters the pieces are known and go to the library's
model; other texts are parted at white space only, which the tokenizer drops, and each part goes
through the whole tokenizer.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

from tokenizers import Tokenizer, pre_tokenizers

from .common import Memo

#: The split pattern of the tokenizer file's pre-tokenizer, and the same for lower-case Latin-1 text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
LATIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"[^ \t\n\r]+")
#: Characters of a text that are looked up at a time.
CHUNK = 1 << 19

_encoders: dict[tuple[bytes, int], WordEncoder] = {}


def encoder(vocabulary: bytes, kept: int = 400_000) -> WordEncoder:
    """The worker's encoder for a tokenizer file's content, which keeps ``kept`` pieces of text."""
    key = hashlib.md5(vocabulary).digest(), kept
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(vocabulary, kept)
    return _encoders[key]


class WordEncoder:
    def __init__(self, vocabulary: bytes, kept: int = 400_000):
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        known = json.loads(vocabulary)
        kinds = [x["type"] for x in (known.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (known.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or splits[:1] != [SPLIT]:
            raise ValueError("the tokenizer file is of another kind: its pieces may depend on each other")
        self.special = [x["content"] for x in known["added_tokens"]]
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: "".join(x for x, _ in spelled.pre_tokenize_str(chr(c))) for c in (*range(33, 127), *range(0xC0, 0x100))}
        self.pieces, self.parts = Memo(self._piece, kept), Memo(self._part, kept)

    def _piece(self, piece: str) -> bytes:
        """Of a lower-case Latin pre-token."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.translate(self.letters))]).tobytes()

    def _part(self, part: str) -> bytes:
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for chunk in chunks(text):
            if LATIN.fullmatch(chunk) and not any(x in chunk for x in self.special):
                out.append(self.pieces.joined(LATIN_SPLIT.findall(chunk.lower())))
            else:
                out.append(self.parts.joined(PARTS.findall(chunk)))
        return out[0] if len(out) == 1 else b"".join(out)


def chunks(text: str):
    """Parts of a text, cut at a space or line end behind each ``CHUNK`` characters."""
    at = 0
    while len(text) - at > CHUNK:
        cuts = [x for x in (text.find(" ", at + CHUNK), text.find("\n", at + CHUNK)) if x >= 0]
        if not cuts:
            break
        yield text[at : min(cuts)]
        at = min(cuts)
    yield text[at:] if at else text
