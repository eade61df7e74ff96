"""Source divergence, conversation prefix trie and token store against brute force and SQL, and on awkward rows."""

import hashlib
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import duck, duck_table, rows_of
from evalgrove.llm import divergence, prefixtrie, queries, tokenstore

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "<|endoftext|> it's  naïve 中文 ÄÖ\n" * 20


def share(n, of):
    return 1 + 10**9 * (n + 2) // of


def distance(p, q):
    return (p - q) ** 2 // (p + q)


def brute_divergence(rows, least, most):
    groups, counts, held = {(lang or "", source or "") for _, lang, source in rows}, Counter(), Counter()
    for text, lang, source in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts.update((lang or "", source or "", t) for t in terms)
        held.update((lang or "", t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (k, t), n in held.items() if k == lang and n >= least]
        own = {s: {t: counts[lang, s, t] for t in kept} for k, s in groups if k == lang}
        v, of = len(kept), {s: sum(c.values()) + 2 * len(kept) for s, c in own.items()}
        every = {t: sum(c[t] for c in own.values()) for t in kept}
        for s, c in own.items():
            pairs = [(-sum(distance(share(c[t], of[s]), share(d[t], of[o])) for t in kept), o) for o, d in own.items() if o != s]
            out += [(lang, s, "pair", o, -x, i + 1) for i, (x, o) in enumerate(sorted(pairs, key=lambda z: (z[0], z[1].encode())))]
            terms = []
            for t in kept:
                p, q = share(c[t], of[s]), share(every[t], sum(of.values()) - 2 * v * (len(of) - 1))
                if c[t] and p > q:
                    terms.append((-distance(p, q), t))
            out += [(lang, s, "term", t, -x, i + 1) for i, (x, t) in enumerate(sorted(terms, key=lambda z: (z[0], z[1].encode()))[:most])]
    return sorted(out)


def got_divergence(df, least, most):
    return sorted(map(tuple, divergence.divergence(df, least, most).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence_matches_sql(spark):
    assert rows_of(queries.op11_source_divergence(spark, SF).toArrow()) == rows_of(duck_table(duck(SF), divergence.ORACLE_SQL))


@pytest.mark.parametrize("combinations", [divergence.COMBINATIONS, 7])
def test_divergence_matches_brute_force(spark, monkeypatch, combinations):
    """Shared paths, terms of one source and of all, ties, nulls, groups without terms, clashing names, very long texts."""
    rng = random.Random(5)
    words = ["a", "B", "b", "é", "É", "x1y", "_", "ch\x85r", "中文", "d-e", "f\x7fg", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(rng.choice(words[: rng.choice([3, 8, 30])]) for _ in range(rng.randrange(30))), rng.choice(["en", "de"]), f"s{rng.randrange(6)}") for _ in range(150)]
    rows += [(None, None, None), ("", "en", None), ("a a", None, "s1"), ("a", None, "s2"), ("b a", None, "s2"), (LONG, "en", "s1"), ("123 !", "en", "nothing"), ("a", "fr", "lonely"), *[("same text", "en", "s2")] * 40]
    if combinations == 7:  # tasks run in this process's workers, so the generator is asked itself
        monkeypatch.setattr(divergence, "COMBINATIONS", 7)
        depth, path = np.array([3, 2, 2]), np.array([0, 1, 2, 0, 1, 0, 2])
        p = np.array([10, 20, 30, 10, 20, 10, 31], np.int64)
        sums = Counter()
        for a, b, v in divergence._corrections(depth, np.array([0, 2, 1]), np.array([2, 3, 5]), np.array([0, 3, 5]), path, p, np.full(7, 2)):
            for x in zip(a.tolist(), b.tolist(), v.tolist(), strict=True):
                sums[x[:2]] += x[2]
        plain = Counter()
        for i, (d, n) in enumerate(zip(depth, (2, 3, 5), strict=True)):
            at = [0, 3, 5][i]
            for j in range(at, at + d):
                for k in range(at, j):
                    plain[int(path[j]), int(path[k])] += n * (distance(p[j], p[k]) - distance(p[j], 2) - distance(2, p[k]) + distance(2, 2))
        assert sums == plain
        return
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit("theirs") for c in ("term", "n", "docs", "place", "p", "rank", "value")})
    assert got_divergence(df, 3, 4) == brute_divergence(rows, 3, 4)
    assert got_divergence(df, 10, 10) == brute_divergence(rows, 10, 10)
    assert divergence.divergence(df.where("false")).count() == 0


def test_divergence_shares_stay_exact(spark):
    big = 9 * 10**15
    r = spark.range(1).select(divergence.share(F.lit(big), F.lit(big + 20)).alias("p"), divergence.share(F.lit(0), F.lit(0)).alias("none")).first()
    assert tuple(r) == (share(big, big + 20), None)


def brute_trie(rows, whole):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [v[1:] for v in sorted(v, key=lambda z: z[0])] for c, v in own.items()}
    if not whole:
        began = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(int(np.fix(c / 100)) * 100, [])[: began[c]] + v[began[c] :] for c, v in own.items()}
    members, children = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        ends = ",".join(map(str, sorted(c for c in m if len(own[c]) == len(k))))
        out[k] = (
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), sum(out[x][5] for x in children[k]) or 1,
            sum(out[x][6] for x in children[k]) + ((len(m) - 1) * len(k[-1][1]) if k else 0), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(map(str, out.values()))


def got_trie(df):
    return sorted(str(tuple(r)) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.fixture(scope="module")
def talks():
    """Conversations that share beginnings, are one another's beginning, or are long copies; absent first ones; null turns, roles and texts."""
    rng = random.Random(3)
    rows = [
        (c, t if t else None, rng.choice(["u", None]) if t % 2 else "u", rng.choice(["", None, "a", "bcd"]))
        for c in [*range(330), -5, -120, -100, 1005] if c not in (100, 7) for t in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 9]))
    ]
    rows += [(3000 + i, t, "u", f"x{t}") for i in range(2) for t in range(700)] + [(3100 + i, t, "u", f"x{t}") for i in range(3) for t in range(150)] + [(None, 0, "u", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("widest", [prefixtrie.WIDEST, 1 << 14])
@pytest.mark.parametrize("whole", [True, False])
def test_trie_matches_brute_force(spark, talks, widest, whole):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("theirs") for c in ("conv", "depth", "x", "y", "n", "chars", "part")}).repartition(5)
    found = prefixtrie.prefix_trie(df, widest) if whole else prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.numbered(df)), widest)
    assert got_trie(found) == brute_trie(talks, whole)


def test_trie_where_the_sketch_proves_little(spark, talks, monkeypatch):
    """With far fewer counters than prefixes nearly all of them are grouped exactly."""
    own = spark.createDataFrame(talks[:800], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(prefixtrie, "SLICE", 64)
    assert got_trie(prefixtrie.prefix_trie(own, 16)) == brute_trie(talks[:800], True)


def test_trie_awkward(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefixtrie.prefix_trie(spark.createDataFrame([], kind)).count() == 0
    again = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "a"), (3, 5, "u", LONG)]
    assert got_trie(prefixtrie.prefix_trie(spark.createDataFrame(again, kind))) == brute_trie(again, True)


def test_trie_matches_sql(spark):
    assert rows_of(queries.op12_prefix_trie(spark, SF).toArrow()) == rows_of(duck_table(duck(SF), prefixtrie.ORACLE_SQL))


def test_running_values_across_ranges(spark):
    """One key holds most rows and spans ranges."""
    rng = np.random.default_rng(2)
    rows = [(0 if i % 10 else i, i, int(v)) for i, v in enumerate(rng.integers(-(2**62), 2**62, 3000))]
    df = spark.createDataFrame(rows, "k long, o long, v long").withColumn("w", F.pmod("v", F.lit(1000))).repartition(7)
    found = prefixtrie.running(df, "k", [F.col("o")], {"x": ("xor", "v"), "s": ("sum", "w")}, "test-rows").collect()
    by, last = defaultdict(lambda: [0, 0]), {k: o for k, o, _ in sorted(rows, key=lambda r: r[1])}
    expected = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        by[k] = [by[k][0] ^ v, by[k][1] + v % 1000]
        expected[o] = (*by[k], last[k] == o)
    assert {r["o"]: (r["x"], r["s"], r["ends"]) for r in found} == expected


def test_sketch_never_says_too_little():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    sketch = prefixtrie.Sketch(1 << 14)
    sketch.add(np.concatenate([x, x[:1000]]), np.concatenate([y, y[:1000]]))
    once = sketch.once(x, y)
    assert not once[:1000].any() and once[1000:].mean() > 0.9
    other = prefixtrie.Sketch(1 << 14)
    for at, data in sketch.slices():
        other.put(at, data)
    assert (other.counts == sketch.counts).all()


def test_id_digests_of_a_large_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).alias("x"), F.lit(1).cast("long").alias("y"), (F.col("id") - 500).alias("v"))
    found = {r["x"]: r["sha256"] for r in prefixtrie.id_digests(df, ["x", "y"], "v", block_bytes=1000).collect()}
    own = ",".join(str(i - 500) for i in range(20_000) if i % 10 or i == 0)
    assert found[0] == hashlib.sha256(own.encode()).hexdigest() and found[20] == hashlib.sha256(b"-480").hexdigest() and len(found) == 2000


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 70_001, dtype=np.uint64).astype(np.uint32)
    data = tokenstore.packed(ids, width)
    assert len(data) == (len(ids) * width + 7) // 8 and (tokenstore.unpacked(data, width, 0, len(ids)) == ids).all()
    for begin, length in ((0, 0), (1, 1), (37, 500), (65_530, 4_000), (70_000, 1)):
        assert (tokenstore.unpacked(data, width, begin, length) == ids[begin : begin + length]).all()
    with pytest.raises(ValueError):
        tokenstore.packed(np.array([1 << 5], np.uint32), 5)


LIBRARY = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def plain_ids(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_token_store_matches_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = 0
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_files(spark, SF).collect()}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = plain_ids(r["text"])
        assert got.pop(r["doc_id"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_token_store_awkward(spark):
    rows = [(5, None), (2, ""), (2, LONG), (None, "no id"), (7, "x"), (7, "x"), (-3, "\x1c 👍🏽")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("theirs") for c in ("shard", "block", "before", "ids", "start", "width")})
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    tokenstore.write(df, folder, P.path("byte_bpe_50k.json"), P.PATTERN, block_ids=4)
    found = sorted(tokenstore.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [-3, 2, 2, 5, 7, 7, None]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == sorted((str(i), plain_ids(t).tobytes()) for i, t in rows)
    assert [r["start"] for r in found] == list(np.cumsum([0] + [r["n_tokens"] for r in found])[:-1])
    wanted = spark.createDataFrame([(7, 0, 9), (-3, 1, 2), (99, 0, 1)], "doc_id long, begin int, length int")
    stretches = sorted((r["doc_id"], r["ids"]) for r in tokenstore.read_stretches(spark, folder, wanted).collect())
    assert stretches == [(-3, plain_ids(rows[-1][1])[1:3].tolist()), (7, plain_ids("x").tolist()), (7, plain_ids("x").tolist())]
    assert set(tokenstore.read_blocks(spark, folder).select("width").distinct().toPandas()["width"]) == {16}
    empty = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    tokenstore.write(df.where("false"), empty, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert tokenstore.read(spark, empty).count() == 0


def test_samples_are_never_silently_empty(spark):
    from evalgrove.llm.common import sampled

    rows = spark.range(100_000)
    assert sampled(rows, "id", 200_000, "s").count() == 100_000
    assert abs(sampled(rows, "id", 5000, "s").count() - 5000) < 400
    assert 0 < sampled(rows, "id", 30, "s").count() < 80
    with pytest.raises(ValueError, match="empty"):
        sampled(rows, "id", 0, "s")


@pytest.mark.parametrize("most", [1_000_000, 50])
def test_hot_keys_are_joined_by_broadcast(spark, monkeypatch, most):
    """One key with half of all rows, one just under the relative bound; with an absolute bound both are spread."""
    from evalgrove.llm import graph

    monkeypatch.setattr(graph, "ROWS_A_TASK", most)
    rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 0).when(F.col("id") < 380, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    met = graph.joined_by(rows, table, "k", 200_000)
    assert met.agg(F.count("*"), F.sum(F.xxhash64("k", "v", "m").cast("decimal(38,0)"))).first() == rows.join(table, "k").agg(F.count("*"), F.sum(F.xxhash64("k", "v", "m").cast("decimal(38,0)"))).first()
    edges = spark.range(1, 60_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") - 1).alias("a"), F.col("id").alias("b"))
    assert {r["component"] for r in graph.connected_components(edges).select("component").distinct().collect()} == {0}
