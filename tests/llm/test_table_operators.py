"""Mixing, sharding, near-duplicates, search and the pipeline against brute force."""

import random
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import bpe, common, components, mixing, quality_rules, secret_scan, sharding, simhash, topk_search

from .conftest import EXTRA, NAMES, SCHEMA, prose

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def keyed(rows):
    return sorted(rows, key=repr)


# --- mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 450 - 200 - 83.3333333, 83.3333333])
    assert mixing.targets([10, 1000]) == pytest.approx([20, 1495])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    for sizes in ([5, 50, 500], [500, 5, 50, 7, 7, 7, 90], [1, 1, 1, 10**6]):
        got = mixing.targets(sizes)
        assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))


def test_pivotal_keeps_the_words_of_a_source():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 60)
        sizes = np.array([r.choice([0, 1, 5, 50, 900]) for _ in range(n)])
        chances = np.array([r.choice([0.0, 1.0, r.random()]) for _ in range(n)])
        x, held = mixing.pivotal(sizes, chances, np.arange(n), 0)
        loose = [i for i in range(n) if 1e-9 < x[i] < 1 - 1e-9]
        assert loose == ([held] if held >= 0 else []) and ((x >= 0) & (x <= 1)).all()
        assert (sizes * x).sum() == pytest.approx((sizes * chances).sum(), rel=1e-6, abs=1e-6)


def test_pivotal_keeps_each_chance():
    sizes, chances = np.array([3, 5, 8, 2, 9]), np.array([0.2, 0.5, 0.7, 0.9, 0.4])
    total = np.zeros(5)
    for trial in range(4000):
        x, _ = mixing.pivotal(sizes, chances, np.array([trial * 5 + i + 1 for i in range(5)]), 0)
        total += x
    assert np.abs(total / 4000 - chances).max() < 0.04


def test_the_last_document_keeps_its_chance(spark):
    """Of 40 documents of one source, each is taken as often as it is wanted, over many runs of the whole rounding."""
    r = random.Random(6)
    sizes = [r.choice([1, 3, 10, 50, 200]) for _ in range(40)]
    total, trials = np.zeros(40), 3000
    for trial in range(trials):
        group = mixing.pd.DataFrame({"size": sizes, "h": [hash((trial, i)) for i in range(40)], "x": 0.37, "blocks": 1, "at": range(40)})
        out = mixing._rounded(0)(group)
        assert not out["loose"].any() and set(out["x"]) <= {0.0, 1.0}
        assert abs((out["x"] * out["size"]).sum() - 0.37 * sum(sizes)) <= 200
        total += out.sort_values("at")["x"].to_numpy()
    assert np.abs(total / trials - 0.37).max() < 0.04


def word_count(text):
    return len((text or "").encode().split())


def slow_targets(sizes):
    """Shares by weight, those above their caps cut, and what is over dealt anew, until nothing is."""
    weight, left, free, out = [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), set(range(len(sizes))), {}
    while free:
        unit = left / sum(weight[i] for i in free)
        over = {i for i in free if unit * weight[i] > 2 * sizes[i]}
        if not over:
            out |= {i: unit * weight[i] for i in free}
            break
        out |= {i: 2.0 * sizes[i] for i in over}
        left -= sum(2 * sizes[i] for i in over)
        free -= over
    return [out[i] for i in range(len(sizes))]


def test_targets_match_dealing_again_and_again():
    r = random.Random(8)
    for _ in range(300):
        sizes = [r.choice([0, 1, 7, r.randint(1, 10**r.randint(1, 6))]) for _ in range(r.randint(1, 30))]
        assert mixing.targets(sizes) == pytest.approx(slow_targets(sizes), rel=1e-9, abs=1e-6)
    many = mixing.targets([r.randint(1, 1000) for _ in range(200_000)])
    assert len(many) == 200_000


def slow_mix(kinds, block_rows, fan):
    """kinds: [(id, source, size, hash, m, block number or None)] -> copies, by rounding exact fractions; blocks and random numbers as stated."""
    by = defaultdict(list)
    for kind in kinds:
        by[kind["source"]].append(kind)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, slow_targets([sum(k["size"] * k["m"] for k in by[s]) for s in order]), strict=True))
    out = {}
    for s in order:
        total = sum(k["size"] * k["m"] for k in by[s])
        ratio = goal[s] / total if total else 0.0
        blocks = -(-len(by[s]) // block_rows)
        groups = defaultdict(list)
        for k in by[s]:
            wanted = ratio * k["m"]
            out[k["h"]] = int(wanted // 1)
            groups[k["block"](blocks)].append((k["size"], k["h"], Fraction(wanted - wanted // 1)))
        salt = 0
        while groups:
            left = defaultdict(list)
            for block, docs in groups.items():
                held = None
                for size, h, x in sorted(docs, key=lambda d: (-d[0], d[1])):
                    if size == 0:
                        continue
                    if x <= 1e-9 or x >= 1 - 1e-9:
                        out[h] += round(x)
                        continue
                    if held is None:
                        held = (size, h, x)
                        continue
                    (a, g, y), up, down = held, min(held[0] * (1 - held[2]), size * x), min(held[0] * held[2], size * (1 - x))
                    moved = up if mixing._uniform(g, h, salt) < down / (up + down) else -down
                    held = None
                    for d in ((a, g, y + moved / a), (size, h, x - moved / size)):
                        if 1e-9 < d[2] < 1 - 1e-9:
                            held = d
                        else:
                            out[d[1]] += round(d[2])
                if held:
                    if blocks <= fan**salt:
                        out[held[1]] += mixing._uniform(held[1], ~held[1], salt + 7919) < held[2]
                    else:
                        left[block // fan].append(held)
            groups, salt = left, salt + 1
    return goal, out


@pytest.mark.parametrize("block_rows,fan", [(1024, 256), (8, 3)])
def test_mix_matches_brute_force(spark, docs, monkeypatch, block_rows, fan):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(mixing, "FAN", fan)
    r = random.Random(8)
    more = spark.createDataFrame([(500 + i, "w " * r.randint(0, 60), "en", r.choice("aab"), 1, *EXTRA) for i in range(400)], SCHEMA)
    table = docs.unionByName(more)
    deal = {x["h"]: x["d"] for x in table.select(F.xxhash64("doc_id", "source", "text").alias("h")).withColumn("d", F.xxhash64("h")).collect()}
    seen = Counter((x["doc_id"], x["source"], word_count(x["text"]), x["h"]) for x in table.withColumn("h", F.xxhash64("doc_id", "source", "text")).collect())
    kinds = [{"source": s, "size": n, "h": h, "m": m, "block": lambda blocks, h=h: deal[h] % blocks} for (_, s, n, h), m in seen.items()]
    goal, copies = slow_mix(kinds, block_rows, fan)
    want = []
    for (key, s, n, h), m in seen.items():
        source_size = sum(k["size"] * k["m"] for k in kinds if k["source"] == s)
        want += [(key, n, source_size, round(goal[s], 6), n * (copies[h] // m + (i < copies[h] % m))) for i in range(m)]
    got = [(x["doc_id"], x["size"], x["source_size"], round(x["target"], 6), x["taken"]) for x in mixing.op3(table).collect()]
    assert keyed(got) == keyed(want)


def check_mix(got, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += word_count(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, slow_targets([sizes[s] for s in order]), strict=True))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in order:
        assert abs(taken[s] - goal[s]) <= largest[s] + 1
    return taken


def mixed(docs):
    """A row for each document, with its source."""
    m = mixing.mix(docs).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    share = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("_n") < F.col("copies") % F.col("m"), 1).otherwise(0)
    return m.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * share).alias("taken")).collect()


def test_mix_meets_its_targets(docs, rows, empty):
    got = mixed(docs)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], word_count(r[1])) for r in rows)
    check_mix(got, rows)
    again = mixing.op3(docs.repartition(7)).collect()
    assert keyed(tuple(r) for r in again) == keyed(tuple(r) for r in mixing.op3(docs).collect())
    assert mixing.op3(empty).count() == mixing.repeated(empty).count() == 0


def test_many_equal_rows_are_one_kind(spark):
    rows = spark.range(1_000_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("s").alias("source"))
    table = rows.union(spark.createDataFrame([(100 + i, "w " * 40, "t") for i in range(30)], "doc_id long, text string, source string"))
    got = mixing.op3(table).groupBy("doc_id", "taken").count().collect()
    assert sum(x["count"] for x in got) == 1_000_030 and {x["taken"] for x in got if x["doc_id"] == 7} <= {3, 6}
    total = sum(x["taken"] * x["count"] for x in got)
    assert total == pytest.approx(1.5 * (3_000_000 + 1200), abs=60)
    assert mixing.repeated(table).filter("doc_id = 7").count() == sum(x["taken"] // 3 * x["count"] for x in got if x["doc_id"] == 7)


def test_repeated_rows_of_the_mix(docs, rows):
    out = mixing.repeated(docs)
    assert out.columns == NAMES
    taken = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for r in mixing.mix(docs, identity=F.xxhash64(*[F.col(c) for c in NAMES])).collect():
        want[r["doc_id"]] += r["copies"]
    assert taken == +want


# --- sharding


def greedy(sizes, shards):
    """(size, shard) of each item, the longest first, each to the least loaded shard."""
    loads, out = [0] * shards, Counter()
    for size in sorted(sizes, reverse=True):
        s = loads.index(min(loads))
        loads[s] += size
        out[size, s] += 1
    return out


def test_schedule_is_longest_first():
    r = random.Random(2)
    for shards in (1, 2, 7, 40):
        for _ in range(60):
            sizes = [r.choice([1, 3, 16, 17, 40, r.randint(1, 1000), 50_000]) for _ in range(r.randint(0, 400))]
            got = sharding.schedule(list(Counter(sizes).items()), shards)
            assert {(size, s): k for size, s, _, k in got} == greedy(sizes, shards)
            for size, n in Counter(sizes).items():
                ranks = sorted((first, k) for x, _, first, k in got if x == size)
                assert [f for f, _ in ranks] == [sum(k for _, k in ranks[:i]) for i in range(len(ranks))] and sum(k for _, k in ranks) == n


def test_shards(docs, rows, empty):
    got = sharding.op4(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    shards = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["grown_shard"] is None
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    own = defaultdict(set)
    for r in got:
        if r["text_crc32"]:
            own[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in own.values())
    assert sharding.op4(empty).count() == 0


@pytest.mark.parametrize("part", [65_536, 50])
def test_shards_are_those_of_scheduling_the_groups(spark, monkeypatch, part):
    monkeypatch.setattr(sharding, "PART_GROUPS", part)
    r = random.Random(3)
    texts = ["t" * r.randint(1, 40) + str(i) for i in range(3000)] + ["copy " * 30] * 60 + ["giant " * 3000] * 20 + [None] * 7 + [""] * 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.assign(table).collect()
    groups, own = Counter(), {}
    for row in got:
        text = texts[row["doc_id"]]
        assert own.setdefault(text, row["shard"]) == row["shard"]
        groups[text] += len((text or "").encode()) + 16
    assert Counter((n, own[text]) for text, n in groups.items()) == greedy(groups.values(), 40)


def test_equal_rows_are_spread_over_tasks(spark):
    """A million rows of one id and text: one group, numbered in parts; the joins of the rows are by broadcast."""
    rows = spark.range(1_000_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text")).union(spark.range(100).select("id", F.col("id").cast("string")))
    placed = sharding.op4(rows)
    found = placed.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert all((x["d"], x["low"], x["high"]) == (x["n"], 0, x["n"] - 1) for x in found)
    assert max(x["n"] for x in found) == 1_000_000 and sum(x["n"] for x in found) == 1_000_100
    parts = rows.repartition(8).select("doc_id", F.lit(9).alias("size"), F.lit(9).alias("text_crc32"), F.lit(0).alias("shard"))
    most = sharding.slots(simhash.cut_lineage(parts)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 1_000_100


# --- near-duplicates


def slow_fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    width = min(3, len(ws))
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + width]), seed=42) for i in range(len(ws) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points):
    """point -> root by trying all pairs."""
    points = sorted(set(points))
    up = {p: p for p in points}

    def find(p):
        while up[p] != p:
            up[p] = up[up[p]]
            p = up[p]
        return p

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    return {p: find(p) for p in points}


def slow_op5(rows):
    fps = [(r[0], slow_fingerprint(r[1])) for r in rows]
    root = classes(f for _, f in fps)
    least = {}
    for key, f in fps:
        if key is not None:
            least[root[f]] = min(key, least.get(root[f], key))
    return keyed((key, f"{f:016x}", least.get(root[f])) for key, f in fps)


def test_near_duplicates(docs, rows, empty):
    assert keyed(tuple(r) for r in simhash.op5(docs).collect()) == slow_op5(rows)
    assert simhash.op5(empty).count() == simhash.dedup(empty).count() == 0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_frequent_and_rare_keys_are_joined_alike(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_PARTS", 10)
    r = random.Random(3)
    rows = [(i, r.choice([1, 1, 1, 2, 2, *range(3, 60)])) for i in range(500)]
    table = spark.createDataFrame([(k, k * k, n) for k, n in Counter(k for _, k in rows).items()], "key long, square long, n long")
    got = common.by_key(spark.createDataFrame(rows, "id long, key long"), table, "key", "n")
    assert keyed((x["id"], x["key"], x["square"]) for x in got.collect()) == keyed((i, k, k * k) for i, k in rows)


def near_points(seed):
    r = random.Random(seed)
    points = {r.getrandbits(64) for _ in range(150)} | {0, (1 << 64) - 1}
    for p in list(points)[:60]:
        for _ in range(r.randint(0, 4)):
            p ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            points.add(p)
    hub = r.getrandbits(64)
    points |= {hub ^ (1 << b) for b in range(0, 64, 2)} | {hub ^ 0b111}
    return points | {hub ^ (x << 8 * r.randint(0, 7)) for x in range(40)}


def shared_bytes(a, b):
    return sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in range(8))


@pytest.mark.parametrize("posting", [128, 6, 1])
def test_links_are_all_pairs_of_near_fingerprints(spark, monkeypatch, posting):
    monkeypatch.setattr(simhash, "POSTING", posting)
    points = near_points(7)
    table = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    got = Counter((x["a"], x["b"], x["bytes"]) for x in simhash.links(table).collect())
    want = Counter((*sorted((signed(a), signed(b))), shared_bytes(a, b)) for a in points for b in points if a < b and (a ^ b).bit_count() <= 2)
    assert got == want and len(want) > 500
    root = {x["u"]: x["root"] for x in components.components(simhash.links(table)).collect()}
    together, brute = defaultdict(set), defaultdict(set)
    for p in points:
        together[root.get(signed(p), signed(p))].add(p)
    for p, c in classes(points).items():
        brute[c].add(p)
    assert keyed(map(sorted, together.values())) == keyed(map(sorted, brute.values()))


def test_tallies_of_the_index_are_the_shared_bytes(spark):
    """All pairs that share six positional bytes have three blocks in common at least, all others one at most."""
    points = sorted(near_points(9))
    table = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    tally = Counter((x["a"], x["b"]) for x in simhash.hits(table).distinct().collect())
    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            n = shared_bytes(a, b)
            assert tally[tuple(sorted((signed(a), signed(b))))] in {4: (0, 1), 5: (1,), 6: (3,), 7: (7,)}.get(n, (0,))


def test_a_very_long_posting(spark):
    """More than a hundred thousand fingerprints of one posting, a few of them linked."""
    r = random.Random(31)
    points = list({0x1122334400000000 | x for x in r.sample(range(1 << 32), 100_500)})
    near = [p ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32, 64)) for p in points[:50]] + [p ^ 0b11 for p in points[50:100]]
    every = sorted({*points, *near})
    got = {(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(signed(p),) for p in every], "fp long")).collect()}
    assert {tuple(sorted((signed(a), signed(b)))) for a, b in zip(points, near, strict=False) if a != b} <= got
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    some = set(every)
    flips = [1 << x for x in range(64)] + [(1 << x) | (1 << y) for x in range(64) for y in range(x)]
    for p in r.sample(every, 300):
        assert {signed(p ^ f) for f in flips if p ^ f in some} == {b if a == signed(p) else a for a, b in got if signed(p) in (a, b)}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (1000, 1001), (5000, 5000), (None, 7), (8, None), (None, None)]
    random.Random(1).shuffle(edges)
    got = {r["u"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components.components(spark.createDataFrame([], "a long, b long, u string")).count() == 0


def test_dedup_keeps_one_of_each(docs, rows):
    out = simhash.dedup(docs)
    assert out.columns == NAMES
    kept = out.collect()
    root = classes(slow_fingerprint(r[1]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[root[slow_fingerprint(r[1])]].append(r[0])
    assert Counter(r["doc_id"] for r in kept) == Counter(min((k for k in keys if k is not None), default=None) for keys in by.values())


# --- search


def slow_topk(rows):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in vectors if i % 50 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    return keyed(out)


def vectors(n, seed, bits=2):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.randint(-(2**bits), 2**bits) / 2**bits)) for _ in range(6)]) for i in range(n)]
    return rows + [(n, None), (n + 1, [None] * 6), (n + 2, [float("nan")] + [0.0] * 5), (50 * (n // 50 + 9), [float("inf")] * 6), (None, [0.5] * 6), (n + 3, [1.0, 2.0]), (1, rows[1][1])]


@pytest.mark.parametrize("blocks", [None, 4])
def test_topk(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 30)
        monkeypatch.setattr(topk_search, "QUERY_BLOCK", 2)
        monkeypatch.setattr(topk_search, "LEAST_BLOCKS", 2)
        monkeypatch.setattr(topk_search, "FAN", 3)
    rows = vectors(320, 4)
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    assert keyed(tuple(r) for r in topk_search.op8(table).collect()) == slow_topk(rows)


def test_an_id_with_two_vectors_is_two_queries(spark):
    rows = vectors(120, 8) + [(50, [0.25, 0.5, -0.5, 1.0, 0.0, 0.75]), (100, [0.5] * 6), (100, [0.5] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = keyed(tuple(r) for r in topk_search.op8(table).collect())
    assert got == slow_topk(rows) and sum(q == 50 for q, *_ in got) == 10


def test_topk_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-1.0, 1.0])]
    assert keyed(tuple(r) for r in topk_search.op8(spark.createDataFrame(few, schema)).collect()) == slow_topk(few)
    assert topk_search.op8(spark.createDataFrame([], schema)).count() == 0
    assert topk_search.op8(spark.createDataFrame([(0, [1.0])], schema)).count() == 0


def test_topk_matches_its_sql(spark):
    rows = [(i, v) for i, v in vectors(200, 6)[:200]]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got = topk_search.op8(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert keyed(tuple(r) for r in got) == keyed(con.execute(topk_search.OP8_SQL).fetchall())


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 1.0, 3.0]]), np.array([[2.0**20, 1.0, -1.0], [2.0**50, 0.0, 0.0]])
    assert topk_search.products(a, b).tolist() == [[2**60 - 2, (1 << 63) - 1]]


# --- pipeline


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    r = random.Random(21)
    more = [(2000 + i, prose(r, "en", 60) + " password=abcdefgh12345", "en", "src1", 0, *EXTRA) for i in range(5)]
    plain = spark.createDataFrame([*rows, *more], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scan", "source_mixing", "bpe_encoding"]

    table = [(x[0], x[1], x[2], x[3]) for x in [*rows, *more]]
    kept_ids = Counter((x["doc_id"], x["n_words"], x["word_chars"]) for x in quality_rules.op2(plain).filter("kept").collect())
    measured = lambda t: (len(t.encode().split()), sum(len(w.decode()) for w in t.encode().split()))
    kept = [x for x in table if x[1] is not None and (x[0], *measured(x[1])) in kept_ids]
    root = classes(slow_fingerprint(x[1]) for x in kept)
    groups = defaultdict(list)
    for x in kept:
        groups[root[slow_fingerprint(x[1])]].append(x)
    ones = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    field = secret_scan.trained()
    clean = [(x[0], secret_scan.redact(x[1], field), x[2], x[3]) for x in ones]
    assert any("[secret]" in x[1] for x in clean)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x[0]: library.encode_ordinary(x[1]) for x in clean}
    assert all(x["token_ids"] == ids[x["doc_id"]] and x["n_tokens"] == len(ids[x["doc_id"]]) for x in got)
    copies = Counter(x["doc_id"] for x in got)
    taken = [{"doc_id": x[0], "source": x[3], "size": word_count(x[1]), "taken": word_count(x[1]) * copies[x[0]], **goal(clean)[x[3]]} for x in clean]
    check_mix(taken, clean)


def goal(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += word_count(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return {s: {"source_size": sizes[s], "target": t} for s, t in zip(order, mixing.targets([sizes[s] for s in order]), strict=True)}


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, docs):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "unused").columns == NAMES
