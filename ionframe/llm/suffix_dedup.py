"""Removal of long repeated passages with Burrows-Wheeler interval expansion.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
in a document with a smaller doc_id. All strings are judged on the input and
never cross documents.

1. Every window of LENGTH bytes is named by its smallest k-gram hash (winnowing),
   so equal windows have equal names. Neighbouring windows with one name form a
   run: the bytes they cover are the run's context. A task merges equal contexts
   of its own documents first - all but the smallest document's are covered -
   so that a common passage sends one context a task, not one a document.
2. Names are dealt by hash. A context that a smaller document also has is
   covered whole. Names with several different contexts need strings compared.
3. Only for those, one copy of each context is fetched from its document. Per
   bucket the contexts are joined to one text, whose Burrows-Wheeler transform is
   expanded backward breadth-first: the intervals of level l give the longest common
   prefixes of length l, in increasing order, and the expansion stops at LENGTH.
   Places still without a value join suffixes that agree on at least LENGTH bytes;
   the smallest document of such a group covers the others.
4. Covered runs and windows go back to their documents and are cut out.

Contexts are told apart by 112 bits (48 of the name, 64 of the content) of a
polynomial whose base is drawn anew for each run; contexts longer than ``LONG`` bytes
(periodic text) by a cryptographic digest of their bytes.

A name that has many different contexts already in one task's share (a common line
with ever other neighbours) is hot: its contexts are dealt over all buckets by their
own hash, and a mark at the name's place makes the contexts of other tasks hot too.
Hot contexts are compared window by window: a task sorts the windows it fetched by
their bytes, keeps those of the smallest document, and deals only these on by window.
So no group grows with the number of documents that share a name or a window, only
with the number of tasks.

Edge cases: null text is empty; texts shorter than LENGTH lose nothing; texts of any
length are read whole; equal doc_ids cover nothing of each other; a null doc_id counts
as larger than all others; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionframe.llm.hashing import mix, rolling
from ionframe.llm.shared import BROADCAST_IDS, groups_for, release, small_batches, text_or_empty, written

LENGTH = 50
GRAM = 28
#: Contexts above so many bytes are told apart by a digest.
LONG = 512
#: Text that a task gathers before it merges equal contexts and sends them on.
GATHER = 2 << 20
#: Bytes of text a name bucket stands for, and bytes of context a string bucket holds.
PER_NAME_BUCKET = 3 << 20
PER_STRING_BUCKET = 3 << 18
#: Contexts of one name that one bucket compares; names with more are hot.
CONTEXTS = 4000
#: Different contexts in one gathering that make a name hot, at most; less where so
#: many gatherings could bring together more than ``NAME_ROWS`` contexts of a name.
HOT = 64
NAME_ROWS = 4_000_000
#: Windows of hot contexts that a task sorts at once, and contexts that it sends on at once.
WINDOWS = 50_000
SENT_AT_ONCE = 20_000
LAST = (1 << 63) - 1
#: Never occurs in UTF-8; the largest byte, so that it never ends the smaller of two suffixes' differing prefixes.
SEPARATOR = 0xFF
LOW48 = np.uint64((1 << 48) - 1)


def document_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def runs(data: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, contexts, and first and past-last window of each run of a text."""
    if len(data) < LENGTH:
        none = np.array([], np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    with np.errstate(over="ignore"):
        hashes = rolling(base)
        power, n = np.uint64(base), 1
        h = data.astype(np.uint64) + np.uint64(1)
        by = {1: h}
        while 2 * n <= GRAM:
            h = h[:-n] * power + h[n:]
            power, n = power * power, 2 * n
            by[n] = h
        grams, rest = h, GRAM - n
        while rest:  # append the binary parts of the gram length
            part = 1 << (rest.bit_length() - 1)
            count = len(data) - (n + part) + 1
            grams = grams[:count] * hashes.power(part) + by[part][n:n + count]
            n, rest = n + part, rest - part
        least, span, wide = grams, 1, LENGTH - GRAM + 1
        while 2 * span <= wide:
            least, span = np.minimum(least[:-span], least[span:]), 2 * span
        if span < wide:
            least = np.minimum(least[:span - wide], least[wide - span:])
        edge = np.flatnonzero(least[1:] != least[:-1]) + 1
        starts = np.concatenate(([0], edge))
        ends = np.concatenate((edge, [len(least)]))
        contexts = hashes.span_hash(hashes.prefix_sums(data), starts, ends + (LENGTH - 1))
        for k in np.flatnonzero(ends - starts > LONG - LENGTH).tolist():
            told = hashlib.blake2b(data[starts[k]:ends[k] + LENGTH - 1].tobytes(), digest_size=8)
            contexts[k] = int.from_bytes(told.digest(), "little")
        return mix(least[starts]) & LOW48, contexts, starts, ends


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _by_context(name: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with equal names together, and in them rows with equal contexts."""
    key = (name << np.uint64(16)) | (context >> np.uint64(48))
    order = np.argsort(key)
    key, context = key[order], context[order]
    same = key[1:] == key[:-1]
    if np.any(context[1:][same] != context[:-1][same]):  # 16 bits of a context were not enough
        group = np.cumsum(np.concatenate(([True], ~same))) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][same & (context[1:] != context[:-1])]] = True
        at = np.flatnonzero(mixed[group])
        by = np.lexsort((context[at], group[at]))
        order[at], context[at] = order[at][by], context[at][by]
    return name[order], context, doc[order]


def _packed48(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _unpacked(blobs: object, kind: str = "<u8") -> np.ndarray:
    """Values of many byte strings, one after the other."""
    return np.frombuffer(b"".join(blobs), kind)


def _stretches(doc: np.ndarray) -> list[tuple[int, int]]:
    if not len(doc):
        return []
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))).tolist()
    return list(zip(cut, [*cut[1:], len(doc)], strict=True))


#: kind PLAIN or DEALT (by context: hot names): names and contexts of the documents in
#: ``docs`` (run lengths in ``counts``); MARK: hot names at their own place; bucket < 0:
#: contexts of the one document that are covered.
PLAIN, DEALT, MARK = range(3)
SENT = "bucket int, kind int, docs binary, counts binary, names binary, contexts binary"


def _named(docs: DataFrame, buckets: int, hot_at: int, base: int) -> DataFrame:
    columns = ["bucket", "kind", "docs", "counts", "names", "contexts"]

    def place(hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(buckets)).astype(np.int64)

    def dealt(kind: int, bucket: np.ndarray, name: np.ndarray, context: np.ndarray, doc: np.ndarray) -> list[tuple]:
        order = np.lexsort((doc, bucket))
        name, context, doc, bucket = name[order], context[order], doc[order], bucket[order]
        out = []
        for a, b in _stretches(bucket):
            cut = np.array(_stretches(doc[a:b]))
            out.append((int(bucket[a]), kind, doc[a:b][cut[:, 0]].tobytes(), (cut[:, 1] - cut[:, 0]).astype("<u4").tobytes(), _packed48(name[a:b]), context[a:b].tobytes()))
        return out

    def send(held: list[tuple]) -> pd.DataFrame:
        names, contexts, docs_ = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(names):
            return pd.DataFrame([], columns=columns)
        names, contexts, docs_ = _by_context(names, contexts, docs_)
        new_name = np.concatenate(([True], names[1:] != names[:-1]))
        new = new_name | np.concatenate(([True], contexts[1:] != contexts[:-1]))
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(docs_, first)
        out = []
        late = np.flatnonzero(docs_ > least[np.cumsum(new) - 1])
        late = late[np.argsort(docs_[late])]
        doc, context = docs_[late], contexts[late]
        for a, b in _stretches(doc):
            out.append((-1 - int(doc[a]) % buckets, PLAIN, doc[a:a + 1].tobytes(), b"", b"", context[a:b].tobytes()))
        name, context = names[first], contexts[first]
        name_at = np.cumsum(new_name[first]) - 1
        hot = (np.bincount(name_at) >= hot_at)[name_at]
        out += dealt(PLAIN, place(name[~hot]), name[~hot], context[~hot], least[~hot])
        if hot.any():
            with np.errstate(over="ignore"):
                out += dealt(DEALT, place(mix(name[hot] + context[hot])), name[hot], context[hot], least[hot])
            marked = np.unique(name[hot])
            marked = marked[np.argsort(place(marked), kind="stable")]
            out += [(int(place(marked[a:a + 1])[0]), MARK, b"", b"", _packed48(marked[a:b]), b"") for a, b in _stretches(place(marked))]
        return pd.DataFrame(out, columns=columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch["doc"].tolist(), batch["text"], strict=True):
                names, contexts, _, _ = runs(as_bytes(text), base)
                held.append((names, contexts, np.full(len(names), doc, np.int64)))
                size += len(text)
                if size >= GATHER:
                    made, held, size = send(held), [], 0
                    release()
                    yield made
        if held:
            yield send(held)
        release()

    return docs.mapInPandas(run, SENT)


#: COVERED: contexts of a document covered whole. ASKED, ASKED_HOT: names and contexts
#: to fetch from a document, to be compared whole or window by window.
COVERED, ASKED, ASKED_HOT = range(3)
FOUND = "kind int, doc long, names binary, contexts binary"


def _judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    columns = ["kind", "doc", "names", "contexts"]
    if key[0] < 0:
        out = [(COVERED, int(np.frombuffer(d, "<i8")[0]), b"", c) for d, c in zip(rows["docs"], rows["contexts"], strict=True)]
        return pd.DataFrame(out, columns=columns)
    marked = np.unique(_unpacked48(b"".join(rows.loc[rows["kind"] != PLAIN, "names"])))
    rows = rows[rows["kind"] != MARK]
    if rows.empty:
        return pd.DataFrame([], columns=columns)
    name, context, doc = _by_context(
        _unpacked48(b"".join(rows["names"])), _unpacked(rows["contexts"]),
        np.repeat(_unpacked(rows["docs"], "<i8"), _unpacked(rows["counts"], "<u4")))
    out = []
    new_name = np.concatenate(([True], name[1:] != name[:-1]))
    new = new_name | np.concatenate(([True], context[1:] != context[:-1]))
    first = np.flatnonzero(new)
    owner = np.minimum.reduceat(doc, first)
    late = np.flatnonzero(doc > owner[np.cumsum(new) - 1])
    late = late[np.argsort(doc[late])]
    out += [(COVERED, int(doc[late[a]]), b"", context[late[a:b]].tobytes()) for a, b in _stretches(doc[late])]
    # names with several contexts of different documents: strings must be compared
    name, context = name[first], context[first]
    name_at = np.cumsum(new_name[first]) - 1
    begin = np.flatnonzero(new_name[first])
    contexts_of = np.bincount(name_at)
    differ = np.maximum.reduceat(owner, begin) != np.minimum.reduceat(owner, begin)
    is_marked = np.isin(name[begin], marked)
    hot = is_marked | (contexts_of > CONTEXTS)
    for kind, wanted in ((ASKED, (contexts_of > 1) & differ & ~hot), (ASKED_HOT, hot & (differ | is_marked))):
        ask = np.flatnonzero(wanted[name_at])
        ask = ask[np.argsort(owner[ask])]
        out += [(kind, int(owner[ask[a]]), _packed48(name[ask[a:b]]), context[ask[a:b]].tobytes()) for a, b in _stretches(owner[ask])]
    release()
    return pd.DataFrame(out, columns=columns)


#: One context to compare: its document, context hash and bytes; or windows of hot
#: contexts side by side, with their documents, contexts and places in these; or, in a
#: bucket below 0, windows of a context that are already known to be covered.
STRINGS = "bucket int, doc long, context long, data binary, docs binary, contexts binary, places binary"
STRING_COLUMNS = [c.split()[0] for c in STRINGS.split(", ")]


def _spans(doc: np.ndarray, context: np.ndarray, place: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Document, context and [first, last) pairs of the given windows."""
    if not len(doc):
        return []
    order = np.lexsort((place, context, doc))
    doc, context, place = doc[order], context[order], place[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (context[1:] != context[:-1])))
    edge = new | np.concatenate(([True], place[1:] > place[:-1] + 1))
    first = np.flatnonzero(edge)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    pairs = np.stack([place[first], place[last] + 1], axis=1).astype("<u4")
    begin = np.searchsorted(first, np.flatnonzero(new))
    cuts = [*begin.tolist(), len(first)]
    at = np.flatnonzero(new)
    return [(int(doc[k]), int(context[k]), pairs[a:b].tobytes()) for k, a, b in zip(at.tolist(), cuts, cuts[1:], strict=False)]


def _window_rows(held: list[tuple[int, int, np.ndarray]], buckets: int, base: int) -> list[tuple]:
    """Hot contexts (document, context, bytes) cut into windows: those of the smallest
    document here are dealt on, the others are covered."""
    cut = [np.lib.stride_tricks.sliding_window_view(data, LENGTH) for _, _, data in held]
    windows = np.concatenate(cut)
    n = np.array([len(c) for c in cut])
    doc, context = (np.repeat(np.array([h[k] for h in held], np.int64), n) for k in (0, 1))
    place = np.arange(len(windows)) - np.repeat(np.cumsum(n) - n, n)
    order = np.argsort(np.ascontiguousarray(windows).view(f"V{LENGTH}").ravel(), kind="stable")
    windows, doc, context, place = windows[order], doc[order], context[order], place[order]
    new = np.concatenate(([True], (windows[1:] != windows[:-1]).any(axis=1)))
    least = np.minimum.reduceat(doc, np.flatnonzero(new))
    covered = doc > least[np.cumsum(new) - 1]
    out = [(-1 - d % buckets, d, c, s, b"", b"", b"") for d, c, s in _spans(doc[covered], context[covered], place[covered])]
    windows, doc, context, place = windows[~covered], doc[~covered], context[~covered], place[~covered]
    hashes = np.zeros(len(windows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LENGTH):
            hashes = hashes * np.uint64(base) + windows[:, k]
        bucket = (mix(hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    windows, doc, context, place, bucket = windows[order], doc[order], context[order], place[order].astype("<u4"), bucket[order]
    return out + [(int(bucket[a]), 0, 0, windows[a:b].tobytes(), doc[a:b].tobytes(), context[a:b].tobytes(), place[a:b].tobytes()) for a, b in _stretches(bucket)]


def _fetch(buckets: int, base: int) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot: list[tuple] = []
        n_hot = 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text, asks in zip(batch["doc"].tolist(), batch["text"], batch["asks"], strict=True):
                if len(out) >= SENT_AT_ONCE:
                    yield pd.DataFrame(out, columns=STRING_COLUMNS)
                    out = []
                data = as_bytes(text)
                own_names, own, starts, ends = runs(data, base)
                raw = data.tobytes()
                for kind in (ASKED, ASKED_HOT):
                    mine = [a for a in asks if a["kind"] == kind]
                    if not mine:
                        continue
                    want, want_names = _unpacked(a["contexts"] for a in mine), _unpacked48(b"".join(a["names"] for a in mine))
                    order = np.argsort(want, kind="stable")
                    at = order[np.minimum(np.searchsorted(want, own, sorter=order), len(want) - 1)]
                    met = np.flatnonzero((want[at] == own) & (want_names[at] == own_names))
                    met = met[np.unique(own[met], return_index=True)[1]]  # one place of each context
                    told = own.view(np.int64)[met].tolist()
                    a, b = starts[met].tolist(), (ends[met] + (LENGTH - 1)).tolist()
                    if kind == ASKED:
                        places = (own_names[met] % np.uint64(buckets)).astype(np.int64).tolist()
                        out += [(p, doc, c, raw[i:j], b"", b"", b"") for p, c, i, j in zip(places, told, a, b, strict=True)]
                        continue
                    for c, i, j in zip(told, a, b, strict=True):
                        hot.append((doc, c, data[i:j]))
                        n_hot += j - i - LENGTH + 1
                        if n_hot >= WINDOWS:
                            out += _window_rows(hot, buckets, base)
                            hot, n_hot = [], 0
            yield pd.DataFrame(out, columns=STRING_COLUMNS)
        if hot:
            yield pd.DataFrame(_window_rows(hot, buckets, base), columns=STRING_COLUMNS)
        release()

    return run


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least (prefix doubling)."""
    n, pad = len(text), np.zeros(8, np.uint8)
    wide = np.concatenate((text, pad)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | wide[k:k + n]
    known = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1]))).astype(np.uint64)
        if known >= depth:
            return order
        later = np.zeros(n, np.uint64)
        later[:n - known] = rank[known:] + np.uint64(1)
        key = (rank << np.uint64(32)) | later
        known *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, least: int = LENGTH) -> np.ndarray:
    """Where neighbouring suffixes in ``order`` have a common prefix of ``least``
    bytes or more (entry k: of suffixes k-1 and k).

    Breadth-first backward extension: an interval of suffixes that begin with a
    string w gives, through the transform's last-to-first map, the intervals of cw
    for every byte c before it. A boundary met first at level |w| has that prefix
    length; the expansion ends at ``least`` and leaves longer ones unset.
    """
    n = len(text)
    last = text[order - 1]  # the transform
    by_byte = np.argsort(last, kind="stable").astype(np.int32)
    to_first = np.empty(n, np.int32)
    to_first[by_byte] = np.arange(n, dtype=np.int32)
    same = last[by_byte[1:]] == last[by_byte[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_byte[1:][same]] = by_byte[:-1][same]
    after[by_byte[:-1][same]] = by_byte[1:][same]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(least):
        if not len(lo):
            break
        size = hi - lo
        total = np.cumsum(size, dtype=np.int32)
        at = np.repeat(lo - (total - size), size) + np.arange(total[-1], dtype=np.int32)
        owner = np.repeat(np.arange(len(lo), dtype=np.int32), size)
        real = last[at] != SEPARATOR
        is_first, is_last = real & (before[at] < lo[owner]), real & (after[at] >= hi[owner])
        f, t = np.flatnonzero(is_first), np.flatnonzero(is_last)
        f = f[np.argsort(owner[f].astype(np.int64) * 256 + last[at[f]], kind="stable")]
        t = t[np.argsort(owner[t].astype(np.int64) * 256 + last[at[t]], kind="stable")]
        begin, end = to_first[at[f]], to_first[at[t]] + 1
        new = unset[end]
        unset[end[new]] = False
        lo, hi = begin[new], end[new]
    return unset[:n]


#: Windows of a context that a smaller document covers: [first, last) pairs.
SPANS = "doc long, context long, spans binary"


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    columns = ["doc", "context", "spans"]
    if key[0] < 0:
        return rows[["doc", "context", "data"]].set_axis(columns, axis=1)
    is_whole = rows["docs"].map(len) == 0
    whole, cut = rows[is_whole], rows[~is_whole]
    windows = _unpacked(cut["data"], np.uint8).reshape(-1, LENGTH)
    beside = np.concatenate([windows, np.full((len(windows), 1), SEPARATOR, np.uint8)], axis=1)
    text = np.concatenate([np.frombuffer(b"".join(d + b"\xff" for d in whole["data"]), np.uint8), beside.ravel()])
    lengths = np.concatenate([np.array([len(d) for d in whole["data"]], np.int64), np.full(len(windows), LENGTH)])
    doc = np.concatenate([whole["doc"].to_numpy(), _unpacked(cut["docs"], "<i8")])
    context = np.concatenate([whole["context"].to_numpy(), _unpacked(cut["contexts"], "<i8")])
    place = np.concatenate([np.zeros(len(whole), np.int64), _unpacked(cut["places"], "<u4").astype(np.int64)])
    order = suffix_order(text)
    joined = long_prefixes(text, order)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    at = np.searchsorted(begins, order, "right") - 1
    fits = order - begins[at] + LENGTH <= lengths[at]
    docs = doc[at]
    group = np.cumsum(~joined) - 1
    least = np.minimum.reduceat(np.where(fits, docs, LAST), np.flatnonzero(~joined))
    covered = order[fits & (docs > least[group])]
    owner = np.searchsorted(begins, covered, "right") - 1
    del order, joined, at, fits, docs, group
    release()
    return pd.DataFrame(_spans(doc[owner], context[owner], covered - begins[owner] + place[owner]), columns=columns)


RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(base: int) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, wholes, parts in zip(batch["doc"].tolist(), batch["text"], batch["wholes"], batch["parts"], strict=True):
                data = as_bytes(text)
                gone = covered_bytes(data, wholes, parts, base)
                edges = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                out.append((doc, len(data), int(gone.sum()), int((edges == 1).sum()), data[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept"])
        release()

    return run


def covered_bytes(data: np.ndarray, wholes: object, parts: object, base: int) -> np.ndarray:
    """Mask of the bytes that covered runs and windows cover."""
    _, own, starts, ends = runs(data, base)
    change = np.zeros(len(data) + 1, np.int64)
    if wholes is not None and len(wholes):
        full = np.isin(own, _unpacked(wholes))
        np.add.at(change, starts[full], 1)
        np.add.at(change, ends[full] + LENGTH - 1, -1)
    if parts is not None and len(parts):
        spans: dict[int, list] = {}
        for p in parts:
            spans.setdefault(p["context"], []).append(np.frombuffer(p["spans"], "<u4").reshape(-1, 2).astype(np.int64))
        signed = own.view(np.int64)
        for k in np.flatnonzero(np.isin(signed, np.fromiter(spans, np.int64, len(spans)))).tolist():
            for s in spans[int(signed[k])]:
                np.add.at(change, starts[k] + s[:, 0], 1)
                np.add.at(change, starts[k] + s[:, 1] + LENGTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def repeated(docs: DataFrame, base: int) -> DataFrame:
    """``doc, wholes, parts``: what is covered of the documents that lose something."""
    small_batches(docs.sparkSession)
    texts = docs.select(document_key().alias("doc"), text_or_empty().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = groups_for(size, PER_NAME_BUCKET, 64)
    hot_at = max(2, min(HOT, NAME_ROWS // groups_for(size, GATHER)))
    found = written(_named(texts, names, hot_at, base).groupBy("bucket").applyInPandas(_judge, FOUND), "found")
    asked = found.where(F.col("kind") != COVERED)
    asks = written(asked.groupBy("doc").agg(F.collect_list(F.struct("kind", "names", "contexts")).alias("asks")), "asks")
    # 8 bytes tell a context; one holds about 75 bytes, and some twelve windows
    bytes_of = F.when(F.col("kind") == ASKED, 75).otherwise(12 * (LENGTH + 1))
    volume = asked.agg(F.sum(F.octet_length("contexts") / 8 * bytes_of).cast("long")).first()[0] or 0
    strings = groups_for(volume, PER_STRING_BUCKET, 24)
    fetched = _needed(texts, asks).mapInPandas(_fetch(strings, base), STRINGS)
    parts = fetched.groupBy("bucket").applyInPandas(_compare, SPANS)
    wholes = found.where(F.col("kind") == COVERED).groupBy("doc").agg(F.collect_list("contexts").alias("wholes"))
    parts = parts.groupBy("doc").agg(F.collect_list(F.struct("context", "spans")).alias("parts"))
    return written(wholes.join(parts, "doc", "full_outer"), "told")


def _needed(texts: DataFrame, by_doc: DataFrame) -> DataFrame:
    """``texts`` joined with ``by_doc``; only documents of ``by_doc`` are shuffled
    while their ids are few enough to be broadcast."""
    ids = by_doc.select("doc")
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    return texts.join(by_doc, "doc")


def drawn_base() -> int:
    """A random base (5 modulo 8, so that its powers are many)."""
    return secrets.randbits(64) & ~7 | 5


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``doc (key), n_bytes, n_removed, n_spans, kept (bytes)`` of each row."""
    base = drawn_base()
    told = repeated(docs, base)
    texts = docs.select(document_key().alias("doc"), text_or_empty().alias("text"))
    cut = _needed(texts, told).mapInPandas(_cut(base), RESULT)
    ids = told.select("doc")
    few = ids.count() <= BROADCAST_IDS
    rest = texts.join(F.broadcast(ids) if few else ids, "doc", "left_anti")
    n = F.octet_length("text").cast("long")
    return cut.unionByName(rest.select("doc", n.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept")))


def _id() -> Column:
    return F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id")


def repeat_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    return cut_repeats(docs).select(_id(), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; other columns stay as they are.

    Bytes of a cut character that remain are dropped; ``n_chars`` is brought up to
    date; documents of which nothing remains stay, with empty text.
    """
    base = drawn_base()
    told = repeated(docs, base)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column("row"))
            texts = rows.column(at).to_pylist()
            for k, (wholes, parts) in enumerate(zip(batch.column("wholes").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                if wholes is not None or parts is not None:
                    data = as_bytes(texts[k] or "")
                    texts[k] = data[~covered_bytes(data, wholes, parts, base)].tobytes().decode(errors="ignore")
            yield rows.set_column(at, rows.schema.field(at), pa.array(texts, pa.string()))
        release()

    rows = docs.select(F.struct("*").alias("row"), document_key().alias("doc"))
    out = rows.join(told, "doc", "left").select("row", "wholes", "parts").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_or_empty()).cast("long")) if "n_chars" in docs.columns else out
