"""Token ids of texts with a public byte-level BPE vocabulary, as little-endian uint32 bytes."""

from __future__ import annotations

import base64
import functools
import re
import sys
from array import array

import numpy as np

#: Kept chunks and their longest length: bounds the cache of one Python worker (about 75 MB).
CACHED_CHUNKS = 350_000
CACHED_CHARS = 40
#: Marks after a word that are always a piece of their own, when nothing but the word stands before them.
MARKS = frozenset(".,;:!?")
_TOUCHING = re.compile(r"\s\s|[^\S \n]")


class Encoder:
    """Encodes texts exactly as the tokenizer file does, but chunk by chunk.

    Where a single space stands between two other characters that are not
    white space, the vocabulary's pre-tokenizer always starts a new piece, so
    a text's ids are the ids of its space-separated chunks one after another,
    and ids of frequent chunks can be kept.  Texts with runs of white space
    are encoded whole; texts with a special token's own string go to the
    tokenizer file itself, which gives that string the special id.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._json_path = json_path
        self._whole = None
        plain = self._plain
        marks = {m: plain(m) for m in MARKS}
        line_end = plain("\n")

        class Chunks(dict):
            """Ids of " " + chunk, and of the rest of a chunk that begins with a line end."""

            def __missing__(self, chunk: str) -> bytes:
                if not chunk:
                    return plain(" ")
                word, end, more = chunk.partition("\n")
                if end and word:
                    # a lone line end is a piece of its own, and no space stands before what follows
                    return self[word] + line_end + self["\n" + more] if more else plain(" " + chunk)
                if chunk[-1] in MARKS and chunk[:-1].isalpha():
                    ids = self[chunk[:-1]] + marks[chunk[-1]]
                else:
                    ids = plain(more if end else " " + chunk)
                if len(chunk) <= CACHED_CHARS and len(self) < CACHED_CHUNKS:
                    self[chunk] = ids
                return ids

        self._chunks = Chunks()

    def _plain(self, text: str) -> bytes:
        ids = array("I", self._bpe.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _by_file(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._json_path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            return self._by_file(text)
        if _TOUCHING.search(text):
            return self._plain(text)
        first, *rest = text.split(" ")
        return self._plain(first) + b"".join(map(self._chunks.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(json_path, ranks_path, pattern)


def public_files() -> tuple[str, str, str]:
    """The byte-level 50k vocabulary: its tokenizer file, the same vocabulary as ranks, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
