"""Token ids of whole texts with a tokenizer file of the ``tokenizers`` library, fast for corpora.

The tokenizer's ids for a text are the ids of its pieces between white space, one after the other: it drops
white space before it merges, and no special token contains any. So each distinct piece is encoded once and
looked up afterwards. Texts are cut at blanks and line feeds only; other white space stays inside a piece and
is left to the tokenizer.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from netspark.llm.workers import worker_state

#: Pieces, and pre-tokens, that a worker remembers (about 0.15 kB each); a full memory starts anew.
CACHE_PIECES = 500_000
#: Visible ASCII and Latin letters that need no composing and stay below U+0250 in lower case.
SIMPLE = re.compile(r"[!-~ªµºÀ-ÖØ-öø-įı-ſȘ-ț]+")
#: How the tokenizer cuts such text in lower case.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9]|[^a-z0-9ªµºß-öø-ɏ]+")
#: Longer pieces are encoded each time.
CACHE_CHARS = 64


class PieceIds(dict):
    """Ids of a piece of text as bytes (little-endian unsigned 16 bit); a missing piece is encoded."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > 1 << 16:
            raise ValueError(f"a vocabulary of {size} tokens does not fit 16 bits")
        self.stems: dict[str, bytes] = {}
        levels = ByteLevel(add_prefix_space=False, use_regex=False)
        #: The letters that bytes of characters below U+0250 are to the model.
        self.letters = {k: levels.pre_tokenize_str(chr(k))[0][0] for k in range(128, 0x250)}

    def __missing__(self, piece: str) -> bytes:
        ids = self._encode(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def _encode(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            low = piece.lower()
            return self.stems.get(low) or self._stem(low)
        # Visible ASCII and Latin letters are cut as the tokenizer cuts them, and each pre-token merged by itself.
        if SIMPLE.fullmatch(piece) is None or "<|" in piece:
            return self._whole(piece)
        low = piece.lower()
        if low.isalpha():
            return self.stems.get(low) or self._stem(low)
        known = self.stems.get
        return b"".join([known(part) or self._stem(part) for part in PRE_TOKENS.findall(low)])

    def _whole(self, piece: str) -> bytes:
        return array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _stem(self, low: str) -> bytes:
        """Ids of a pre-token in lower case that is not remembered."""
        ids = self._merged(low if low.isascii() else low.translate(self.letters))
        if len(low) <= CACHE_CHARS:
            if len(self.stems) >= CACHE_PIECES:
                self.stems.clear()
            self.stems[low] = ids
        return ids

    def _merged(self, pre_token: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(pre_token)]).tobytes()

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has; different pieces are looked up once."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().cast(pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        every = np.frombuffer(b"".join(found), "<u2")
        piece = coded.indices.to_numpy()
        many = sizes[piece]
        ends = np.cumsum(many)
        begin = (np.cumsum(sizes) - sizes)[piece] - (ends - many)
        ids = every[np.repeat(begin, many) + np.arange(ends[-1] if len(ends) else 0)]
        pieces = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
        return ids, np.diff(np.concatenate(([0], ends))[pieces], prepend=0)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; a null text has none."""
        if not text:
            return np.empty(0, "<u2")
        pieces = text.replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), "<u2")


def piece_ids(path: str) -> PieceIds:
    return worker_state(f"pieces:{path}", lambda: PieceIds(path))
