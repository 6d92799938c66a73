"""BPE encoding and decoding with a word vocabulary.

Encoder: all tokens of a word are found by one Aho-Corasick pass; from left to
right the longest token is taken whose pair with the token before it is
compatible, else the next shorter one, else the last token is given up. A pair
is compatible when byte-pair merging of the joined strings would keep the
boundary; that is read off the merge table and remembered. Every prefix length
is given up at most once, so the work is linear in the word, and the result is
exactly that of merging by rank.

Decoder: one table of all tokens' bytes and their offsets; the ids of a text
gather their ranges from it. As the vocabulary file names no decoder, tokens are
joined by single spaces, word ends included.

Edge cases: null text is empty: no ids, and empty decoded text; special tokens'
strings in a text get their special ids; of overlapping candidates the longest that
stays compatible wins, so there are no ties; texts of any length are encoded whole;
repeated rows repeat; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ionframe.llm.shared import rows_made, text_or_empty

#: Characters that str.split() takes for spaces and the vocabulary's pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Unicode's White_Space characters (fixed values).
_SPACE = "\t-\r \x85\xa0  -     　"
#: Chunks, words and pairs that a worker remembers; longer strings than LONGEST are
#: encoded anew each time, so what it remembers is bounded in bytes.
MEMO = 400_000
LONGEST = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, next_ = [""] * 256, 256
    for b in range(256):
        if b in shown:
            letters[b] = chr(b)
        else:
            letters[b], next_ = chr(next_), next_ + 1
    return letters


def remember(memo: dict[str, bytes], text: str, ids: bytes) -> None:
    if len(text) <= LONGEST:
        if len(memo) > MEMO:
            memo.clear()
        memo[text] = ids


class WordCodec:
    """Backtracking encoder and offset-table decoder for one vocabulary file."""

    def __init__(self, path: str | None = None):
        import ahocorasick
        import public_tokenizers

        with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            told = json.load(f)
        vocab, self._suffix = told["model"]["vocab"], told["model"]["end_of_word_suffix"]
        self._special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self._find_special = re.compile("(" + "|".join(map(re.escape, self._special)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(pattern.replace(r"\s", _SPACE)).findall
        letters = byte_letters()
        self._code = {letter: b for b, letter in enumerate(letters)}
        self._pairs: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[int, int] = {}  # order of merging; single letters have none
        for rank, (a, b) in enumerate(told["model"]["merges"]):
            left, right = vocab[a], vocab[b]
            joined = vocab[a + b]
            self._pairs[left, right] = joined
            self._parts[joined] = (left, right)
            self._rank[joined] = rank
        self._fits: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        self._reach: dict[int, bool] = {}
        for token, id_ in vocab.items():
            if self._reachable(id_):
                symbols = self._symbols(token)
                self._automaton.add_word(symbols, (len(symbols), id_))
        self._automaton.make_automaton()
        self._memo: dict[str, bytes] = {}  # by chunk
        self._known: dict[str, bytes] = {}  # by word
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self._special.items()}
        spelled = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)

    def _symbols(self, token: str) -> str:
        """Bytes as characters; the byte at a word's end is moved up by 256."""
        end = token.endswith(self._suffix)
        codes = [self._code[c] for c in (token[: -len(self._suffix)] if end else token)]
        if end:
            codes[-1] += 256
        return "".join(map(chr, codes))

    def _reachable(self, id_: int) -> bool:
        """Whether merging a token's own string gives the token."""
        if id_ not in self._parts:
            return True
        if id_ not in self._reach:
            left, right = self._parts[id_]
            self._reach[id_] = self._reachable(left) and self._reachable(right) and self._keeps(left, right, self._rank[id_])
        return self._reach[id_]

    def _keeps(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge ranked below ``limit`` crosses the boundary.

        The merges that built both sides are undone from the latest to the
        earliest; at each moment the two tokens at the boundary could have merged
        only with a rank below that of everything still to be undone.
        """
        pairs, parts, rank = self._pairs, self._parts, self._rank
        while True:
            joined = pairs.get((left, right))
            if joined is not None and rank[joined] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, parts[left][1]
            else:
                # of equal ranks the leftmost merges first: a merge across the boundary
                # that has the right token's own rank would come before it
                limit, right = b + 1, parts[right][0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        fits = self._fits.get(key)
        if fits is None:
            if len(self._fits) > 4 * MEMO:
                self._fits.clear()
            fits = self._fits[key] = self._keeps(left, right, float("inf"))
        return fits

    def encode_word(self, data: bytes) -> list[int]:
        """ids of one word's bytes."""
        n = len(data)
        word = "".join(map(chr, data[:-1])) + chr(data[-1] + 256)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, id_) in self._automaton.iter(word):
            starts[end + 1 - length].append((length, id_))  # shorter ones end earlier
        dead = bytearray(n + 1)
        ids: list[int] = []
        ends = [0]
        options = [starts[0]]
        tries = [len(starts[0]) - 1]
        while ends[-1] < n:
            at, k = ends[-1], tries[-1]
            while k >= 0:
                length, id_ = options[-1][k]
                k -= 1
                if not dead[at + length] and (not ids or self.compatible(ids[-1], id_)):
                    tries[-1] = k
                    ids.append(id_)
                    ends.append(at + length)
                    options.append(starts[at + length] if at + length < n else [])
                    tries.append(len(options[-1]) - 1)
                    break
            else:
                dead[at] = 1
                ids.pop(), ends.pop(), options.pop(), tries.pop()
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """ids of a run without spaces: normalised, then cut into words."""
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return b"".join(map(self._word, self._words(chunk)))

    def _word(self, word: str) -> bytes:
        ids = self._known.get(word)
        if ids is None:
            ids = array("I", self.encode_word(word.encode())).tobytes()
            remember(self._known, word, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        chunks = re.split(f"[{_SPACE}]+", text) if _ODD.search(text) else text.split()
        known = self._memo.get
        parts = list(map(known, chunks))
        if None in parts:
            for k, p in enumerate(parts):
                if p is None:
                    chunk = chunks[k]
                    parts[k] = known(chunk) or self._chunk(chunk)
                    remember(self._memo, chunk, parts[k])
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit bytes."""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(np.array([self._special[p]], "<u4").tobytes() if p in self._special else self._plain(p) for p in self._find_special.split(text))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens, one space between them."""
        at = np.frombuffer(ids, "<u4")
        if not len(at):
            return b""
        starts, widths = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(widths)
        return self.letters[np.repeat(starts - (ends - widths), widths) + np.arange(ends[-1])].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def word_codec(path: str | None = None) -> WordCodec:
    """One codec a worker process."""
    return WordCodec(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) of whole texts."""

    def start() -> Callable:
        codec = word_codec(path)
        return lambda batch: (None, {"ids": [codec.encode(t) for t in batch.column("text").to_pylist()]})

    return rows_made(docs.select("doc_id", text_or_empty().alias("text")), ["doc_id"], {"ids": "binary"}, start)


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: what the ids spell."""

    def start() -> Callable:
        codec = word_codec(path)
        return lambda batch: (None, {"text": [codec.decode(i).decode() for i in batch.column("ids").to_pylist()]})

    return rows_made(ids.select("doc_id", "ids"), ["doc_id", "ids"], {"text": "string"}, start)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, then decodes the ids."""

    def start() -> Callable:
        codec = word_codec(path)

        def run(batch: pa.RecordBatch) -> tuple[None, dict]:
            n, spelt, read = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                spelt.append(hashlib.sha256(ids).hexdigest())
                read.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return None, {"n_tokens": n, "ids_sha256": spelt, "decoded_sha256": read}

        return run

    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return rows_made(docs.select("doc_id", text_or_empty().alias("text")), ["doc_id"], fields, start)
