"""Each operator against a brute-force version on a small fixture with hard cases:
nulls, empty and long texts, ties, repeated rows, further columns, empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ionframe.llm import bpe_codec, chat_format, exact_dedup, kd_sharding, near_dedup, packing, quality, suffix_dedup, token_counts, topk_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, k0 int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, base = words(rng, 60), words(rng, 120)
    near = base.split()
    near[40] = "changed"
    texts = [
        None, "", " ", "a\tb\n\nc", "a b c", base, base, " ".join(near), passage + " " + words(rng, 40),
        words(rng, 30) + " " + passage + " Ünïcödé 中文 " + words(rng, 30), "ab" * 4000, "x" * 50, "x" * 49, "x" * 120,
        "it's <|endoftext|> İΣ don't  stop　now \x1c ", words(rng, 3000), "one two three four", "ONE two three four",
    ] + [words(rng, rng.randint(1, 200)) for _ in range(30)]
    out = [(k, t, "en", "src", len(t or ""), "b", k) for k, t in enumerate(texts)]
    return [*out, (5, base, "en", "src", 1, "b", 1), (None, "no id", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


BIG = 1 << 60
WIDE = "doc_id long, text string, parts string, wholes int, doc_key string, doc string, n long, key string, id int, row string, doc_of int"


@pytest.mark.parametrize("nulls", [False, True])
def test_ids_above_53_bits_and_clashing_columns(spark, nulls):
    """All operators and stages keep every bit of an id, with and without nulls beside it."""
    rng = random.Random(1)
    texts = {BIG + 1: words(rng, 80), BIG + 2: words(rng, 80), BIG + 3: words(rng, 80), -BIG - 5: "short"}
    rows = [(k, t, "p", 1, "d", "x", 7, "k", 3, "r", 4) for k, t in texts.items()] + ([(None, words(rng, 80), None, None, None, None, None, None, None, None, None)] if nulls else [])
    wide = spark.createDataFrame(rows, WIDE).coalesce(1)
    ids = {*texts, *([None] if nulls else [])}
    of = lambda df, c="doc_id": {r[c] for r in df.select(c).collect()}
    model = quality.Model(None, (0.5,))
    for made in (quality.score(wide, model), kd_sharding.shard_documents(wide, 2), bpe_codec.round_trip(wide), bpe_codec.decoded(bpe_codec.encoded(wide)), packing.pack_documents(wide), token_counts.count_tokens(wide), suffix_dedup.repeat_report(wide)):
        assert of(made) == ids
    groups = by_id(exact_dedup.exact_groups(wide))
    assert set(groups) == ids and all(g["keep_id"] == k and g["kept"] for k, g in groups.items())
    near = by_id(near_dedup.near_duplicates(wide))
    assert set(near) == ids and all(g["class_id"] == k and g["kept"] for k, g in near.items())
    turns = spark.createDataFrame([(k, 0, "user", "a") for k in ids], "conv_id long, turn long, role string, text string").coalesce(1)
    assert of(chat_format.formatted(turns), "conv_id") == {*ids, -7}
    for stage in (quality.keep_good(wide, model), exact_dedup.drop_exact_copies(wide), near_dedup.drop_near_copies(wide), suffix_dedup.without_repeats(wide)):
        assert stage.columns == wide.columns and sorted(map(str, stage.collect())) == sorted(map(str, wide.collect()))
    vectors = spark.createDataFrame([(k, [1.0, 0.5]) for k in [20 * (BIG // 20), *texts]] + ([(None, [9.0, 9.0])] if nulls else []), "vec_id long, embedding array<float>").coalesce(1)
    hits = topk_search.search(vectors).collect()
    assert {r["vec_id"] for r in hits} == set(texts) and {r["query_id"] for r in hits} == {20 * (BIG // 20)}


def test_exact_groups(docs, rows, empty):
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows)
    text_of = {r[0]: r[1] for r in rows}
    for g in got:
        ids = groups[norm(text_of[g["doc_id"]])]
        keep = min((i for i in ids if i is not None), default=None)
        assert (g["keep_id"], g["group_size"], g["kept"]) == (keep, len(ids), g["doc_id"] == keep)
        assert g["text_sha256"] == hashlib.sha256(norm(text_of[g["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)  # one row an id, one id a group


def test_cuckoo_index_changes(spark):
    live = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    index = exact_dedup.CuckooIndex.build(exact_dedup.digests(live), 2)
    index = index.insert(exact_dedup.digests(spark.createDataFrame([(0, "b"), (9, "c")], "doc_id long, text string")))
    index = index.delete(exact_dedup.digests(spark.createDataFrame([(1, "a"), (9, "c")], "doc_id long, text string")))
    asked = exact_dedup.digests(spark.createDataFrame([(7, "a"), (7, "b"), (7, "c"), (7, "d")], "doc_id long, text string"))
    assert sorted((r["keep_id"], r["group_size"]) for r in index.lookup(asked).collect()) == [(0, 2), (2, 1)]


def test_cuckoo_bucket_grows_and_deletes():
    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(5000)]
    bucket = exact_dedup.Bucket(expected=1)
    for k, d in enumerate(digests):
        bucket.insert(d, k, 1)
        bucket.insert(digests[k // 2], k, 1)
    assert bucket.filter.buckets > 64 and all(bucket.find(d) is not None for d in digests)
    assert bucket.find(digests[0]) == [0, 3] and bucket.find(digests[1]) == [1, 3]
    for d in digests[:2500]:
        bucket.delete(d)
    assert all(bucket.find(d) is None for d in digests[:2500]) and all(bucket.find(d) is not None for d in digests[2500:])
    again = exact_dedup.Bucket(bucket.table(7))
    assert again.content == bucket.content and again.filter.dump() == bucket.filter.dump()


def test_chat_round_trip(spark):
    hard = ["", None, "<turn user>", "&lt;&amp;<", "\\### Assistant: </turn> ok", "a\n\nb", "é中"]
    turns = [(c, k, ["user", "assistant", "x<>&y"][k % 3], hard[(c + k) % len(hard)]) for c in range(4) for k in range(5)]
    turns.append(turns[-1])
    df = spark.createDataFrame([(*t, "more") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    assert sorted(got) == [-7, 0, 1, 2, 3]
    for c in range(4):
        own = sorted((t[1], t[2], t[3] or "") for t in turns if t[0] == c)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.formatted(df.limit(0)).count() == 1


def test_chat_records_with_odd_keys(spark):
    records = ['{"conv_id": 1, "messages": []}', '{"conv_id": 2, "messages": null}', '{"conv_id": 3, "messages": [{"role": "user", "content": "a", "name": "x"}], "meta": {"lang": "en"}}', '{"prompt": "p", "completion": null}', '{"id": 9007199254740993, "prompt": "p", "completion": "c", "score": 1}']
    got = chat_format.canonical_json(spark.createDataFrame([(r,) for r in records], "record string"))
    assert sorted((r["conv_id"] or 0, r["turn"], r["role"], r["text"]) for r in got.collect()) == [(0, 0, "user", "p"), (3, 0, "user", "a"), (9007199254740993, 0, "user", "p"), (9007199254740993, 1, "assistant", "c")]


def test_chat_layouts(spark):
    records = ['{"id": 1, "instruction": "do", "output": "done"}', '{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', '{"conv_id": 3, "messages": [{"role": "user", "content": "hi"}]}', '{"id": 4, "system": "s", "prompt": "p", "response": "r"}']
    got = chat_format.canonical_json(spark.createDataFrame([(r,) for r in records], "record string"))
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in got.collect()) == [
        (1, 0, "user", "do"), (1, 1, "assistant", "done"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "hi"),
        (4, 0, "system", "s"), (4, 1, "user", "p"), (4, 2, "assistant", "r")]
    with pytest.raises(Exception, match="no mapping"):
        chat_format.canonical_json(spark.createDataFrame([('{"odd": 1}',)], "record string")).collect()


def test_kd_shards(spark, docs, rows, empty):
    got = kd_sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(rows) and {g["law"] for g in got} == {"bytes"}
    for s in range(4):
        assert sorted(g["slot"] for g in got if g["shard"] == s) == list(range(sum(g["shard"] == s for g in got)))
    text_of = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(g["size"] == len(text_of[g["doc_id"]]) + 1 and g["text_crc32"] == zlib.crc32(text_of[g["doc_id"]]) for g in got)
    assert kd_sharding.shard_documents(empty, 4).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 40)).otherwise(F.concat(F.lit("t "), F.sha2(F.col("id").cast("string"), 256), F.lit(" w"))).alias("text"))
    sizes = [r["n"] for r in kd_sharding.shard_documents(many, 16).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.15 * min(sizes)


def test_near_duplicates(docs, rows, empty):
    got = by_id(near_dedup.near_duplicates(docs))
    assert got[7]["class_id"] == 5 and got[6]["class_id"] == 5 and got[5]["kept"]
    assert got[17]["class_id"] == 16 and got[4]["class_id"] == 3
    assert {got[k]["class_id"] for k in (0, 1, 2)} == {0}
    alone = [k for k in got if k is not None and k not in (0, 1, 2, 3, 4, 5, 6, 7, 16, 17)]
    assert all(got[k]["class_id"] == k for k in alone)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_chains_match_brute_force(spark):
    """Chains of small edits: neighbours are near, far members are not."""
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        now = words(rng, 200).split()
        for _ in range(12):
            now = [*now]
            now[rng.randrange(200)] = words(rng, 1)
            now[rng.randrange(200)] = words(rng, 1)
            texts.append(" ".join(now))
    mers = [near_dedup.labelled_kmers(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for i in range(len(texts)):
        for j in range(i):
            if near_dedup.aligned(mers[i], mers[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: r["class_id"] for k, r in got.items()} == {k: find(k) for k in range(len(texts))}


def order_similarity(one, two):
    """Own alignment of two lists of words: longest common run of numbered five-word grams, by
    patience sorting over their places, over all grams of both."""
    import bisect
    from collections import Counter

    def grams(w):
        seen, out = Counter(), []
        for k in range(max(1, len(w) - 4) if w else 0):
            g = tuple(w[k:k + 5])
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    a, b = grams(one), grams(two)
    place = {g: k for k, g in enumerate(b)}
    piles = []
    for g in a:
        if g in place:
            at = bisect.bisect_left(piles, place[g])
            piles[at:at + 1] = [place[g]]
    return len(piles) / max(1, len(a) + len(b) - len(piles))


def test_near_classes_of_the_test_table_equal_brute_force(spark):
    """All pairs that share a five-word gram, aligned by code of its own; classes by union."""
    import re
    from collections import defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    split = {r["doc_id"]: re.findall("[^\x00-\x20]+", (r["text"] or "").lower()) for r in docs.collect()}
    texts = defaultdict(list)
    for k, w in split.items():
        texts[tuple(w)].append(k)
    first = {w: min(ids) for w, ids in texts.items()}
    holders = defaultdict(set)
    for w, k in first.items():
        for at in range(max(1, len(w) - 4) if w else 0):
            holders[w[at:at + 5]].add(k)
    shared = defaultdict(int)
    for ids in holders.values():
        ids = sorted(ids)
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                shared[a, b] += 1
    root = {k: k for k in first.values()}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = 0
    for (a, b), n in shared.items():
        size = len(split[a]) + len(split[b])
        if n >= 0.2 * size / 2 and order_similarity(split[a], split[b]) >= 0.8 - 1e-12:
            x, y = sorted((find(a), find(b)))
            root[y] = x
            links += 1
    expected = {k: find(first[tuple(w)]) for k, w in split.items()}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert links >= 5 and got == expected


def test_near_pairs_in_hot_buckets(spark):
    """Thousands of different texts share one passage; the few near ones share nothing else."""
    rng = random.Random(23)
    passage = words(rng, 140)
    texts = [f"{passage} {words(rng, 50)}" for _ in range(3000)]
    near = [100, 1700, 2900]
    for k in near:
        texts[k] = f"{passage} {words(rng, 8)}"
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: r["class_id"] for k, r in got.items()} == {k: 100 if k in near else k for k in range(3000)}


def generated_rows(plan):
    """Rows that the generators of an executed plan made."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return generated_rows(plan.executedPlan())
    if "QueryStage" in name:
        return generated_rows(plan.plan())
    children = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if name == "Generate" else 0
    return own + sum(generated_rows(children.apply(k)) for k in range(children.size()))


def test_texts_meet_an_anchor_once_whatever_their_buckets(spark):
    """Texts that share all their buckets: pairs as defined, no more rows made than anchors times texts."""
    for n in (300, 600):
        found = []
        for k in range(n):
            mates = near_dedup.TABLES if k % 3 else 5  # some are not in all of them
            found += [(t, 7 * t, n, 0, k.to_bytes(16, "big"), (k - k % 2).to_bytes(16, "big"), 100 + k % 50) for t in range(mates)]
        members = spark.createDataFrame(found, "t int, key long, n long, salt long, id binary, root binary, size long")
        salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / near_dedup.PER_SALT))
        for turn, anchors in enumerate(near_dedup.ANCHORS):
            orders = [F.xxhash64("id", F.lit(turn * 100 + a)).alias(f"h{a}") for a in range(anchors)]
            rows = members.select("t", "id", "root", "size", *orders).collect()
            expected = set()
            for t in range(near_dedup.TABLES):
                own = [r for r in rows if r["t"] == t]
                for a in range(anchors):
                    hub = min(own, key=lambda r: (r[f"h{a}"], bytes(r["id"])))
                    expected |= {
                        tuple(sorted((bytes(r["id"]), bytes(hub["id"])))) for r in own
                        if r["root"] != hub["root"] and min(r["size"], hub["size"]) >= near_dedup.SIMILARITY * max(r["size"], hub["size"])}
            pairs = near_dedup.anchored(members.withColumn("salt", salt), turn)
            got = [(bytes(r["lo"]), bytes(r["hi"])) for r in pairs.collect()]
            assert len(got) == len(set(got)) and set(got) == expected
            made = generated_rows(pairs._jdf.queryExecution().executedPlan())
            assert len(expected) <= made <= 2 * anchors * n


def test_texts_that_share_only_a_passage_are_not_verified(spark, monkeypatch):
    """Buckets of hundreds of texts: what is verified goes with the near ones, not with the bucket."""
    rng = random.Random(29)
    passage = words(rng, 100)
    texts = [f"{passage} {words(rng, 60)}" for _ in range(400)]
    for at in range(100, 120):
        copy = texts[7].split()
        copy[at] = "changed"
        texts.append(" ".join(copy))
    tested, verify = [], near_dedup.verified

    def counted(kmers, pairs):
        tested.append(pairs.count())
        return verify(kmers, pairs)

    monkeypatch.setattr(near_dedup, "verified", counted)
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {k: r["class_id"] for k, r in got.items()} == {k: k if k < 400 else 7 for k in range(420)}
    assert 20 <= sum(tested) <= 200


def test_bits_exclude_no_near_pair(spark):
    """Pairs on both sides of 0.8, with repeats, moves and lengths apart: the bound in SQL and by hand."""
    rng = random.Random(31)
    pairs = []
    for k in range(300):
        one = [f"w{rng.randrange(40 if k % 3 else 10**6)}" for _ in range(rng.choice([5, 30, 150, 700, 3000]))]
        two = list(one)
        for _ in range(rng.randrange(1 + len(one) // 15)):
            at = rng.randrange(len(two))
            two[at:at + rng.randrange(3)] = [f"x{rng.randrange(50)}"] * rng.randrange(3) or ["x"]
        pairs.append([near_dedup.labelled_kmers(" ".join(t)) for t in (one, two)])
    bits = [[near_dedup.turned_bits(m).tolist() for m in p] for p in pairs]
    rows = [(k, len(a), x, (len(b), y)) for k, ((a, b), (x, y)) in enumerate(zip(pairs, bits, strict=True))]
    table = spark.createDataFrame(rows, "k int, size long, bits array<long>, other struct<size: long, bits: array<long>>")
    let = {r["k"] for r in table.where(near_dedup.may_be_near(F.col("other"))).collect()}
    near = {k for k, (a, b) in enumerate(pairs) if near_dedup.aligned(a, b) >= near_dedup.SIMILARITY}
    for (a, b), (x, y) in zip(pairs, bits, strict=True):
        unlike = sum(bin((i ^ j) & (2**64 - 1)).count("1") for i, j in zip(x, y, strict=True))
        assert len(x) * 64 == near_dedup.BITS and unlike <= len(set(a.tolist()) ^ set(b.tolist()))
    assert near <= let and len(near) >= 50 and len(let) <= 290


@pytest.mark.parametrize("most", [0, 300_000])
def test_components_with_and_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", most)
    links = [(k, k + 1) for k in range(20, 27)] + [(9, k) for k in (3, 14, 15)] + [(15, 40)]
    edges = spark.createDataFrame([(a.to_bytes(16, "big"), b.to_bytes(16, "big")) for a, b in links], "a binary, b binary")
    got = {(int.from_bytes(r["id"], "big"), int.from_bytes(r["root"], "big")) for r in near_dedup.components(edges).collect()}
    assert got == {(k, 20) for k in range(21, 28)} | {(k, 3) for k in (9, 14, 15, 40)}


def test_alignment_similarity():
    rng = random.Random(3)
    base = words(rng, 300)
    a = near_dedup.labelled_kmers(base)
    assert near_dedup.aligned(a, a) == 1.0
    swapped = base.split()[150:] + base.split()[:150]  # the same k-mers in another order
    assert near_dedup.aligned(a, near_dedup.labelled_kmers(" ".join(swapped))) < 0.8


def test_packing(docs, rows, empty):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, 256).collect()
    pieces = {}
    for g in got:
        pieces.setdefault(g["doc_id"], []).append((g["piece"], g["start"], g["length"], g["ids_crc32"]))
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(set(pieces[doc_id]))
        assert [p[1] for p in own] == [0, *np.cumsum([p[2] for p in own])[:-1].tolist()] and sum(p[2] for p in own) == len(ids)
        assert all(p[2] == 256 for p in own[1:])
        assert all(p[3] == zlib.crc32(np.array(ids[p[1]:p[1] + p[2]], "<u4").tobytes()) for p in own)
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty).count() == 0


def test_genetic_operators_keep_all_items():
    rng = np.random.default_rng(1)
    sizes = rng.integers(300, 900, 400)
    best = packing.evolve(sizes, [], 1, 2048, 12)[0]
    assert np.bincount(best, sizes).max() <= 2048
    first = packing.best_fit(np.full(400, -1), sizes, np.arange(400), 2048)
    assert packing.lower_bound(sizes, 2048) <= len(set(best)) <= len(set(first))


def test_islands_beat_best_fit_on_triplets(spark):
    """Sizes that fill bins only in exact threes: crossover and migration must find better bins."""
    rng = np.random.default_rng(5)
    sizes = []
    for _ in range(40):
        a, b = rng.integers(500, 900), rng.integers(400, 700)
        sizes += [int(a), int(b), int(2048 - a - b)]
    first = len(set(packing.best_fit(np.full(len(sizes), -1), np.array(sizes), np.arange(len(sizes)), 2048)))
    pieces = spark.createDataFrame([(k, 0, 0, s, k) for k, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, 2048, islands=3, epochs=4, generations=60).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in got) <= 2048 and 40 <= len(got) < first


def test_bpe_codec(docs, rows, empty):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(bpe_codec.round_trip(docs))
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = tk.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec.round_trip(empty).count() == 0


def test_bpe_words_against_the_library():
    rng, codec = random.Random(2), bpe_codec.word_codec()
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(3000):
        word = "".join(rng.choices("etaoinshrdlué'", k=rng.randint(1, 24)))
        assert np.frombuffer(codec.encode(word), "<u4").tolist() == tk.encode(word, add_special_tokens=False).ids


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = [rng.normal(size=8).astype(np.float32).tolist() for _ in range(300)]
    v[10] = v[11] = v[12] = v[20]
    table = [(k, x, 0) for k, x in enumerate(v)] + [(300, None, 0), (320, [1.0, float("nan")] * 4, 0), (340, [None] * 8, 0), (360, [], 0), (380, [float("inf")] * 8, 0), (400, [0.5, 0.5], 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    q = np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)
    got = {}
    for r in topk_search.search(df, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for k in range(0, 300, 20):
        s = q @ q[k]
        best = sorted((-s[i], i) for i in range(300) if i != k)[:5]
        assert sorted(got[k]) == [(n + 1, i, -m) for n, (m, i) in enumerate(best)]
    assert set(got) == set(range(0, 300, 20))
    assert topk_search.search(df.limit(0)).count() == 0


def test_top_k_without_cell_bounds_and_with_several_lengths(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = [(k, rng.normal(size=4 if k % 3 else 6).tolist()) for k in range(900)]
    monkeypatch.setattr(topk_search, "BLOCKS_PER_CELL", 1)
    monkeypatch.setattr(topk_search, "SEEDS", 100)
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in topk_search.search(df, 7).collect()}
    monkeypatch.setattr(topk_search, "BOUND_BYTES", -1)
    assert {tuple(r) for r in topk_search.search(df, 7).collect()} == whole
    v = {k: np.floor(64 * np.array(x)).astype(int) for k, x in table}
    for q in range(0, 900, 20):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q and len(v[c]) == len(v[q]))[:7]
        assert {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)} <= whole
    assert len(whole) == 45 * 7


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_sections(spark, rule):
    text = "alpha beta gamma delta"
    sections = [[(6, 10), (0, 5)], None, [], [(2, 8), (None, 3), (8, 22)]]
    df = spark.createDataFrame([(k, text, s) for k, s in enumerate(sections)], "doc_id long, text string, fields array<struct<start:long,end:long>>")
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spans = tk.encode(text, add_special_tokens=False).offsets
    got = {}
    for r in token_counts.count_tokens(df, "fields", rule).collect():
        if r["n_tokens"]:
            got.setdefault(r["doc_id"], {})[r["start"]] = r["n_tokens"]
    for k, told in enumerate(sections):
        bounds = sorted(s for s in told or [] if s[0] is not None)
        at = lambda c, bounds=bounds: next((a for a, b in bounds if a <= c < b), -1)
        expected = {}
        for a, b in spans:
            inside = [at(c) for c in range(a, b)]
            own = {"first": inside[0], "last": inside[-1], "most": max(inside, key=lambda x: (inside.count(x), -inside.index(x)))}[rule]
            expected[own] = expected.get(own, 0) + 1
        assert got[k] == expected
    assert token_counts.count_tokens(df.limit(0), "fields", rule).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, rows, rule):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = False
    got = {}
    for r in token_counts.count_tokens(docs, rule=rule).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["n_tokens"], r["n_crossing"])
    for doc_id, text in {r[0]: r[1] or "" for r in rows}.items():
        spans = tk.encode(text, add_special_tokens=False).offsets
        line_of = np.cumsum([0, *(c == "\n" for c in text)])  # a line feed belongs to the line it ends
        expected = {}
        for a, b in spans:
            inside = line_of[a:b].tolist()
            line = {"first": inside[0], "last": inside[-1], "most": max(inside, key=lambda x: (inside.count(x), -x))}[rule]
            n, over = expected.get(line, (0, 0))
            expected[line] = (n + 1, over + (inside[0] != inside[-1]))
        assert {k: v for k, v in got[doc_id].items() if v[0]} == expected
        assert len(got[doc_id]) == text.count("\n") + 1


def test_suffix_dedup(docs, rows, empty):
    seen, expected = set(), {}
    for doc_id, text in sorted(((r[0] if r[0] is not None else 1 << 62, r[1] or "") for r in {r[0]: r for r in rows}.values())):
        b = text.encode()
        mask = np.zeros(len(b), bool)
        grams = [b[p:p + 50] for p in range(len(b) - 49)]
        for p, g in enumerate(grams):
            if g in seen:
                mask[p:p + 50] = True
        seen.update(grams)
        edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
        expected[None if doc_id == 1 << 62 else doc_id] = (len(b), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest())
    got = by_id(suffix_dedup.repeat_report(docs))
    assert {k: (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for k, g in got.items()} == expected
    assert sum(e[1] > 0 for e in expected.values()) >= 4
    assert suffix_dedup.repeat_report(empty).count() == 0


def brute_repeats(texts):
    """Bytes removed from each text of (id, text): covered by 50 bytes of a smaller id."""
    owner, out = {}, {}
    for doc_id, text in texts:
        b = text.encode()
        for p in range(len(b) - 49):
            g = b[p:p + 50]
            owner[g] = min(owner.get(g, doc_id), doc_id)
    for doc_id, text in texts:
        b = text.encode()
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if owner[b[p:p + 50]] < doc_id:
                mask[p:p + 50] = True
        out[doc_id] = (int(mask.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "contexts"), [(64, 4000), (3, 4000), (1000, 20)])
def test_common_line_in_many_contexts(spark, monkeypatch, hot, contexts):
    """One line with ever other neighbours, by the plain way and by both ways for hot names."""
    rng = random.Random(31)
    line, other = words(rng, 14), words(rng, 9)
    texts = [(k * 7 % 1501, f"{words(rng, rng.randint(1, 12))} {line}{rng.choice(' .,;')}{words(rng, rng.randint(1, 12))} {other if k % 3 else ''}") for k in range(1500)]
    texts += [(5000, "ab" * 600), (5001, "x" + "ab" * 400 + "y" * 300), (5002, "y" * 90)]
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.repeat_report(docs).collect()}
    assert got == brute_repeats(texts)


def test_interval_expansion_against_brute_force():
    rng = random.Random(8)
    text = np.frombuffer(b"\xff".join(bytes(rng.choices(b"ab", k=rng.randint(1, 60))) for _ in range(40)) + b"\xff", np.uint8)
    order = suffix_dedup.suffix_order(text, 50)
    joined = suffix_dedup.long_prefixes(text, order, 6)
    raw = text.tobytes()
    for k in range(1, len(order)):
        a, b = raw[order[k - 1]:], raw[order[k]:]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == 0xFF), min(len(a), len(b)))
        if a[n:n + 1] != b[n:n + 1]:
            assert joined[k] == (n >= 6)


def test_scores_by_hand(spark):
    """The score of a fitted model, from compressed sizes taken with the library directly."""
    import zstandard

    rng = random.Random(17)
    good, bad = ([" ".join(rng.choices(vocabulary, k=120)) for _ in range(80)] for vocabulary in (words(rng, 60).split(), words(rng, 60).split()))
    docs = spark.createDataFrame(list(enumerate(good + bad)) + [(999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 80), 0) for k in range(160)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert model.dictionaries is not None and all(0 <= s <= 1 for s in got.values())

    def size(data, raw):
        made = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        blocks = [data[k:k + quality.BLOCK] for k in range(0, len(data), quality.BLOCK)]
        return sum(len(made.compress(b)) - len(made.compress(b"")) for b in blocks)

    for k, text in enumerate(good + bad):
        data = text.encode()
        b, g = (size(data, raw) for raw in model.dictionaries)
        x = [1.0, (b - g) / (len(data) + 20), (b - g) / (b + g + 20), (b + g) / (len(data) + 20)]
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30))), rel=1e-9)
    assert np.mean([got[k] >= 0.3 for k in range(80)]) > 0.9 and np.mean([got[k] < 0.3 for k in range(80, 160)]) > 0.9


def test_quality(spark, empty):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels, 800)
    met = quality.score(docs, model).join(labels.where("quality is not null"), "doc_id").where("held_out").toPandas()
    assert len(met) > 500 and met["score"].between(0, 1).all()
    assert (met["predicted"] == met["quality"]).mean() > 0.95
    assert (met.loc[met["quality"] == 1, "predicted"] == 1).mean() > 0.98
    assert quality.score(empty, model).count() == 0 and quality.keep_good(empty, model).count() == 0
    assert quality.train(docs, labels.limit(0)).dictionaries is None


def test_keep_documents_keeps_one_row_a_kept_text(spark):
    from ionframe.llm.shared import keep_documents, text_key

    docs = spark.createDataFrame([(1, "a", "k"), (1, "b", "k"), (2, "c", "k"), (2, "c", "k"), (3, "d", "k"), (None, "e", "k"), (None, "f", "k"), (None, "e", "k")], "doc_id long, text string, key string")
    kept = docs.where("text in ('b', 'c', 'e')").select("doc_id", text_key().alias("key"))
    got = keep_documents(docs, kept, docs.select("doc_id", text_key().alias("key")))
    assert got.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "e"), (1, "b"), (2, "c")]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Good and bad text, copies, near copies and a passage, worked out without the operators."""
    import re
    import zlib

    import corpus_pipeline

    rng = random.Random(77)
    good, bad = (words(rng, 80).split() for _ in range(2))
    text = lambda vocabulary, n: " ".join(rng.choices(vocabulary, k=n))
    passage = text(good, 60)
    texts = [text(good, 150) for _ in range(70)] + [text(bad, 150) for _ in range(70)]
    kind = [1] * 70 + [0] * 70
    texts += [texts[3].replace(" ", " \t"), texts[4]]  # equal but for spaces
    near = texts[5].split()
    near[70] = "other"
    texts += [" ".join(near), text(good, 50) + " " + passage + " é " + text(good, 40), text(good, 30) + " " + passage + " " + text(good, 60)]
    kind += [1] * 5
    ids = [BIG + 7 * k for k in range(len(texts))]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, k, 0) for i, k in zip(ids[:140], kind, strict=False)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {i: t for i, t, k in zip(ids, texts, kind, strict=True) if k}
    seen = set()
    for i in sorted(kept):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", kept[i])
        if key in seen:
            del kept[i]
        seen.add(key)
    for i in sorted(kept):
        if any(j < i and order_similarity(kept[j].split(), kept[i].split()) >= 0.8 for j in list(kept)):
            del kept[i]
    assert len(kept) == 70 + 2
    grams, cut = {}, {}
    for i, t in sorted(kept.items()):
        b = t.encode()
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if grams.setdefault(b[p:p + 50], i) < i:
                mask[p:p + 50] = True
        cut[i] = np.frombuffer(b, np.uint8)[~mask].tobytes().decode(errors="ignore")
    assert sum(cut[i] != kept[i] for i in kept) == 1
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(g["doc_id"], g["start"], g["length"], g["ids_crc32"]) for g in got} == {
        (i, 0, len(told), zlib.crc32(np.array(told, "<u4").tobytes())) for i, t in cut.items() for told in [[*tk.encode(t, add_special_tokens=False).ids, 0]]}
    fills = {}
    for g in got:
        fills[g["sequence_id"]] = fills.get(g["sequence_id"], 0) + g["length"]
    assert max(fills.values()) <= 2048 and len(fills) == 18  # four of these 72 at most in one


def test_pipeline_stages(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    ids = [r["doc_id"] for r in at.collect()]
    assert len(ids) == len(set(ids)) and not {1 + 3, 6, 7, 17} & set(ids) and 5 in ids
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(ids)


def test_pieces_that_are_alike_spread(spark, monkeypatch):
    """A third of all rows null and alike: no instance holds many more than its share."""
    monkeypatch.setattr(packing, "ITEMS", 200)
    docs = spark.createDataFrame([(None, "same text")] * 1500 + [(k, f"text {k}") for k in range(500)], "doc_id long, text string").repartition(4)
    got = packing.pack_documents(docs).collect()
    assert len(got) == 2000 and len({(r["sequence_id"], r["offset"]) for r in got}) == 2000
    counts = np.bincount([r["sequence_id"] >> 40 for r in got])
    assert len(counts) == 10 and counts.max() < 300
