"""Sharding: a k-d tree over document metadata, split at weighted medians.

The law is ``bytes``: shards of nearly equal size. A node is split along its
widest dimension (spread of the node against the spread of the whole table) at
the weighted median; splitting stops when a leaf holds at most the target
bytes, or at the given number of shards. Medians are found by distributed
histograms: every pass counts bytes per (node, bin) and narrows the bin that
holds the median, so what reaches the driver is nodes x BINS sums, whatever
the table's size.

The coordinate is made unique by a hash of the text below the dimension's
value: rows with equal texts have one key and go to one shard. A group of equal
texts is only cut (by a hash of the doc_id) where keeping it whole would move a
split by more than ``CUT`` of a leaf. Slots are numbered through small
(shard, bucket) counts, so no shard is gathered in one task.

Edge cases: null text weighs one byte; texts of any length are measured whole; null dimensions count as 0; repeated
rows share a key, so a single such key may leave a shard empty; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionframe.llm.shared import groups_for, text_or_empty, written

BINS = 1 << 12
#: Share of a leaf's bytes by which a whole group of copies may move a split.
CUT = 0.05
VALUE_BITS, TEXT_BITS = 20, 42
TOP_VALUE = (1 << VALUE_BITS) - 1


@dataclass
class Node:
    lo: int  # shards below this node: [lo, hi)
    hi: int
    dim: int | None = None
    cut: int = 0  # keys at or below go left
    split_key: int | None = None  # the one key whose rows are cut by their id's hash
    split_at: int = 0
    left: Node | None = None
    right: Node | None = None


def text_metadata() -> list[Column]:
    """Three measures of a text: lines, bytes a word, share of non-ASCII characters."""
    text = text_or_empty()
    n = F.octet_length(text)
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" ")))
    return [
        F.length(text) - F.length(F.replace(text, F.lit("\n"))),
        (n * 256 / (spaces + 1)).cast("long"),
        ((n - F.length(text)) * 65536 / F.greatest(n, F.lit(1))).cast("long"),
    ]


def prepared(docs: DataFrame, dims: list[Column] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, k0.. , row_hash``: one sortable key a dimension."""
    text = text_or_empty()
    dims = dims or text_metadata()
    low = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    keys = [(F.greatest(F.lit(0), F.least(F.lit(TOP_VALUE), F.coalesce(d.cast("long"), F.lit(0)))) * (1 << TEXT_BITS) + low).alias(f"k{i}") for i, d in enumerate(dims)]
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *keys,
        F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("row_hash"))


def _value(node: Node | None, leaf: object) -> Column:
    """Nested CASE over the tree; leaf(node) gives the value where it ends."""
    if node.dim is None:
        return leaf(node)
    key = F.col(f"k{node.dim}")
    left = key <= node.cut
    if node.split_key is not None:
        left = left | ((key == node.split_key) & (F.col("row_hash") <= node.split_at))
    return F.when(left, _value(node.left, leaf)).otherwise(_value(node.right, leaf))


def grow(rows: DataFrame, n_dims: int, shards: int) -> Node:
    """The tree over prepared rows with ``shards`` leaves."""
    root = Node(0, shards)
    spread = rows.agg(*[f(f"k{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    whole = [max(1, (spread[f"hi{i}"] or 0) - (spread[f"lo{i}"] or 0)) for i in range(n_dims)]
    level = [root]
    while level := [n for n in level if n.hi - n.lo > 1]:
        _split(rows, root, level, whole, n_dims)
        level = [c for n in level for c in (n.left, n.right) if c is not None]
    return root


def _split(rows: DataFrame, root: Node, level: list[Node], whole: list[int], n_dims: int) -> None:
    index = {id(n): k for k, n in enumerate(level)}
    placed = rows.withColumn("node", _value(root, lambda n: F.lit(index.get(id(n))).cast("int"))).where("node is not null")
    stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("w"), *[f(f"k{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    search: dict[int, dict] = {}
    for k, node in enumerate(level):
        if k in stats:
            s = stats[k]
            dim = max(range(n_dims), key=lambda i: (s[f"hi{i}"] - s[f"lo{i}"]) / whole[i])
            goal = s["w"] * ((node.lo + node.hi + 1) // 2 - node.lo) / (node.hi - node.lo)
            search[k] = {"dim": dim, "lo": s[f"lo{dim}"], "hi": s[f"hi{dim}"], "before": 0, "goal": goal, "leaf": s["w"] / (node.hi - node.lo), "key": True}
    _narrow(placed, search, "key")
    cut_inside = {}
    for k, s in search.items():
        node = level[k]
        node.dim, node.cut = s["dim"], s["lo"] - 1
        short, over = s["goal"] - s["before"], s["before"] + s["w"] - s["goal"]
        if min(short, over) > CUT * s["leaf"] and s["lo"] == s["hi"]:
            node.split_key = s["lo"]
            cut_inside[k] = {"dim": s["dim"], "at": s["lo"], "lo": 0, "hi": (1 << 62) - 1, "before": s["before"], "goal": s["goal"], "leaf": s["leaf"]}
        elif over <= short:
            node.cut = s["hi"]
    if cut_inside:
        _narrow(placed, cut_inside, "row")
        for k, s in cut_inside.items():
            over = s["before"] + s["w"] - s["goal"]
            level[k].split_at = s["hi"] if over <= s["goal"] - s["before"] else s["lo"] - 1
    for node in level:
        mid = (node.lo + node.hi + 1) // 2
        if node.dim is None:  # no rows reach it
            node.hi = node.lo + 1
        else:
            node.left, node.right = Node(node.lo, mid), Node(mid, node.hi)


def _narrow(placed: DataFrame, search: dict[int, dict], what: str) -> None:
    """Narrows [lo, hi] of each search to the bin that holds its goal, until the
    bin is one value or lighter than a thousandth of a leaf."""
    open_ = dict(search)
    while open_:
        value, low, width, ok = F.lit(None).cast("long"), F.lit(0), F.lit(1), F.lit(False)
        for k, s in open_.items():
            s["width"] = (s["hi"] - s["lo"]) // BINS + 1
            here = F.col("node") == k
            col = F.col(f"k{s['dim']}") if what == "key" else F.when(F.col(f"k{s['dim']}") == s["at"], F.col("row_hash"))
            value, low, width = F.when(here, col).otherwise(value), F.when(here, F.lit(s["lo"])).otherwise(low), F.when(here, F.lit(s["width"])).otherwise(width)
            ok = F.when(here, col.between(s["lo"], s["hi"])).otherwise(ok)
        # the remainder goes first, so the quotient is whole but for the division's rounding
        binned = F.round((value - low - F.pmod(value - low, width)) / width).cast("int").alias("b")
        counted = placed.where(ok).groupBy("node", binned).agg(F.sum("size").alias("w")).collect()
        sums: dict[int, dict[int, int]] = {}
        for r in counted:
            sums.setdefault(r["node"], {})[r["b"]] = r["w"]
        for k, s in list(open_.items()):
            before, bins = s["before"], sorted(sums.get(k, {0: 0}).items())
            for b, w in bins:
                if before + w >= s["goal"] or b == bins[-1][0]:
                    break
                before += w
            lo = s["lo"] + b * s["width"]
            s |= {"before": before, "w": w, "lo": lo, "hi": min(s["hi"], lo + s["width"] - 1)}
            if s["lo"] == s["hi"] or w <= s["leaf"] / 1000:
                del open_[k]


def assigned(rows: DataFrame, tree: Node) -> DataFrame:
    """Prepared rows with their ``shard``."""
    return rows.withColumn("shard", _value(tree, lambda n: F.lit(n.lo)).cast("int"))


#: Rows that a window of slots orders, and counts that may be broadcast.
PER_WINDOW, MOST_COUNTS = 20_000, 500_000


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, through (shard, bucket) counts; buckets
    follow the number of rows, and rows that share an id are dealt by their texts."""
    buckets = groups_for(rows.count(), shards * PER_WINDOW, 64)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row_hash", "k0"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row_hash", "doc_id")) - 1
    before = F.broadcast(before) if shards * buckets <= MOST_COUNTS else before
    return dealt.withColumn("place", place).join(before, ["shard", "part"]).withColumn("slot", (F.col("base") + F.col("place")).cast("long")).drop("place", "base", "part")


def shard_documents(docs: DataFrame, shards: int = 16, dims: list[Column] | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row.

    With ``target_bytes`` the number of shards follows from the table's size.
    """
    rows = written(prepared(docs, dims), "kd-keys")
    n_dims = sum(c.startswith("k") and c[1:].isdigit() for c in rows.columns)
    if target_bytes:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    out = with_slots(assigned(rows, grow(rows, n_dims, shards)), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
