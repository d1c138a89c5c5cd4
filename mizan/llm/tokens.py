"""Token ids of whole texts by the tokenizers library, with a piece memo.

Byte-level BPE encodes each pre-token by itself, and this vocabulary's
pre-tokenizer always starts a new one at a space before a non-space and around
a single line feed. Texts without runs of white space are therefore cut there,
and each distinct piece goes through the tokenizer once per worker. Any other
text is encoded whole, so the ids are those of encode() in all cases.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: A run of Latin letters, then at most one run of ASCII marks: two pre-tokens.
_WORD = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: itself where printable, else 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Irregular(Exception):
    """A piece that must be encoded together with its text."""


class Encoder:
    """encode(text) -> bytes of little-endian ids; width is the bytes of one id.

    limit bounds each memo; a full one is emptied.
    """

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.limit = limit
        self.pieces: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.feed = self.whole("\n")
        self.marks: dict[str, bytes] = {}
        self.letters = _byte_letters()
        plain = self.tokenizer.normalizer is None and self.tokenizer.post_processor is None
        #: whether the file's pipeline is the one that the memo relies on
        self.cut = plain and bool(re.match(r"ByteLevel\(add_prefix_space=False, .*use_regex=True", str(self.tokenizer.pre_tokenizer)))

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _word(self, memo: dict[str, bytes], key: str, word: str) -> bytes:
        """Ids of one pre-token given in the model's byte letters."""
        ids = np.array([t.id for t in self.model.tokenize(word)], self.kind).tobytes()
        if len(memo) >= self.limit:
            memo.clear()
        memo[key] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece and the space before it (a line feed stands for itself)."""
        if piece.isascii() and piece.isalpha():
            return self._word(self.pieces, piece, "Ġ" + piece)
        m = _WORD.fullmatch(piece)
        if m:
            feed, key, tail = m.groups()
            memo = self.starts if feed else self.pieces
            ids = memo.get(key)
            known = ids is not None
            if not known:
                word = key if key.isascii() else key.encode().decode("latin-1").translate(self.letters)
                ids = self._word(memo, key, word if feed else "Ġ" + word)
            if feed:
                ids = self.feed + ids
            if tail:
                if tail not in self.marks:
                    if len(self.marks) >= self.limit:
                        self.marks.clear()
                    self.marks[tail] = self.whole(tail)
                ids += self.marks[tail]
            if not known:  # a word with marks is kept from its second time on
                return ids
        else:
            body = piece[1:] if piece[:1] == "\n" else piece
            if not body or "<|" in body or any(map(str.isspace, body)):
                raise Irregular
            ids = self.whole(piece if piece[:1] == "\n" else " " + piece)
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cut:
            return self.whole(text)
        parts = text.replace("\n", " \n").split(" ")
        found = list(map(self.pieces.get, parts))
        try:
            if None in found:
                found = [self._piece(p) if ids is None else ids for p, ids in zip(parts, found, strict=True)]
            first = parts[0]
            if not first or "<|" in first or any(map(str.isspace, first)):
                raise Irregular
            found[0] = self.whole(first)
        except Irregular:
            return self.whole(text)
        return b"".join(found)

    def ids(self, text: str | None, end_id: int) -> np.ndarray:
        """Ids of a text (null: empty) and the end id, in the encoder's width."""
        return np.frombuffer(self.encode(text or "") + end_id.to_bytes(self.width, "little"), self.kind)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
