"""Whole-text encoding with a public byte-level BPE vocabulary.

Texts fall into chunks at single spaces, and chunks repeat: each distinct one is
encoded once per worker and its ids are kept as little-endian bytes, so a text's
ids are one join of byte strings. Texts that hold a special token's string go to the
tokenizers library whole, which gives that string its special id.

Edge cases: an empty text has no ids; texts of any length are encoded whole; texts
must not be None (callers make null empty).
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable

import numpy as np

#: Chunks kept by a worker before its memory is emptied; longer ones are not kept.
MEMO = 400_000
LONGEST = 64
SPECIAL = "<|endoftext|>"
#: A space that is not followed by a word: the chunk rule below does not hold there.
_LOOSE = re.compile(r" (?:\s|\Z)")


class ByteEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes; ``widths``: bytes a token.

    The vocabulary's pattern always begins a new pre-token at a single space that
    a non-space follows, so a text may be cut there and its chunks encoded alone.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        self._json = json_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks = {}
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._core = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._memo: dict[str, bytes] = {}
        self.widths = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
        self.widths[-1] = len(SPECIAL)

    @functools.cached_property
    def _library(self) -> object:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._json)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list = []
        waiting = []  # (position, parts, places and chunks still unknown)
        known = self._memo.get
        for text in texts:
            if SPECIAL in text or _LOOSE.search(text):
                out.append(self._whole(text))
                continue
            chunks = text.split(" ")
            parts = list(map(known, chunks))
            parts[0] = self._plain(chunks[0])
            if None in parts:
                places = [k for k, p in enumerate(parts) if p is None]
                waiting.append((len(out), parts, places, [chunks[k] for k in places]))
                out.append(None)
            else:
                out.append(b"".join(parts))
        if waiting:
            learnt = self._learn({c for w in waiting for c in w[3]})
            for at, parts, places, chunks in waiting:
                for k, chunk in zip(places, chunks, strict=True):
                    parts[k] = learnt[chunk]
                out[at] = b"".join(parts)
        return out

    def _plain(self, text: str) -> bytes:
        return np.asarray(self._core.encode_ordinary(text), "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.asarray(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._plain(text)

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Encodes new chunks as one text and cuts its ids at the chunks' ends."""
        new = list(chunks)
        ids = np.asarray(self._core.encode_ordinary(" " + " ".join(new)), "<u4")
        ends = np.cumsum([len(c.encode()) + 1 for c in new])
        at = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
        raw, cuts = ids.tobytes(), [0, *(at * 4).tolist()]
        learnt = {c: raw[a:b] for c, a, b in zip(new, cuts, cuts[1:], strict=False)}
        kept = {c: i for c, i in learnt.items() if len(c) <= LONGEST}
        if len(self._memo) + len(kept) > MEMO:
            self._memo.clear()
        self._memo.update(kept)
        return learnt


@functools.lru_cache(maxsize=2)
def byte_encoder(json_path: str | None = None, ranks_path: str | None = None) -> ByteEncoder:
    """One encoder a worker process."""
    return ByteEncoder(json_path, ranks_path)
