"""Each corpus operator against a brute-force version, and on awkward rows."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from compare import duck, duck_table, rows_of
from evalgrove.llm import bpe, embeddings, graph, langid, licenses, linededup, mph, packing, quality, queries, simhash, tokencount, toxicity
from evalgrove.llm.common import fold
from evalgrove.llm.tokenfiles import ranks

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "<|endoftext|> it's  naïve 中文 ÄÖ\n" * 20
AWKWARD = [(1, None, "en"), (2, "", None), (3, "  \n\t ", "en"), (4, LONG, "en"), (5, "Some line of text\nother", "de"), (6, "some LINE of text \nother", "de"), (6, "some LINE of text \nother", "de"), (None, "a null id\nsome line of text", "fr"), (8, "\x1c\x85 odd　space 👍🏽", "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward rows, with columns named like the operators' own."""
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    for c in ("n_tokens", "fingerprint", "score", "kept", "words", "id", "gone", "n_words", "rule"):
        df = df.withColumn(c, F.lit("theirs"))
    return df


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(rows):
    return {r["doc_id"]: r["text"] or "" for r in rows.select("doc_id", "text").collect()}


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    made = mph.MinimalPerfectHash.build(keys)
    again = mph.MinimalPerfectHash.from_bytes(*made.to_bytes())
    assert sorted(again.numbers(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        mph.MinimalPerfectHash.build(np.zeros(2, np.uint64))


def test_line_dedup_matches_sql(spark):
    con = duck(SF)
    assert rows_of(queries.op1_line_dedup(spark, SF).toArrow()) == rows_of(duck_table(con, linededup.ORACLE_SQL))


def test_line_dedup_awkward(spark, docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.line_dedup(docs.where("doc_id is null or doc_id <> 4")).collect())
    assert got == [
        ((False, 1), "", 1, 0), ((False, 2), "", 1, 0), ((False, 3), "  \n\t ", 2, 0), ((False, 5), "Some line of text\nother", 2, 0), ((False, 6), "other", 2, 1), ((False, 6), "other", 2, 1),
        ((False, 8), "\x1c\x85 odd　space 👍🏽", 1, 0), ((True, None), "a null id", 2, 1),
    ]
    kept = linededup.line_dedup(docs)
    assert kept.columns == [*docs.columns, "n_lines", "n_dropped"] and kept.count() == len(AWKWARD)
    assert linededup.line_dedup(docs.where("false")).count() == 0


def test_line_dedup_of_a_very_common_line(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line everywhere\nown line number "), F.col("id")).alias("text"))
    r = linededup.line_dedup(rows).agg(F.sum("n_dropped").alias("n"), F.min_by("n_dropped", "doc_id").alias("first")).first()
    assert tuple(r) == (2999, 0)


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = brute_components({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in expected.items())
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_simhash_matches_brute_force(spark, real):
    own = texts(real)
    fp = {i: plain_fingerprint(t, 3) for i, t in own.items()}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    expected = brute_components(own, linked)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op2_simhash(spark, SF).collect()}
    assert got == {i: (fp[i], expected[i]) for i in own}


@pytest.mark.parametrize("crowd", [4096, 2])
def test_simhash_links_of_close_fingerprints(spark, monkeypatch, crowd):
    """Both ways: pairs under shared keys, and meeting points for crowded ones."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (12, 2))} | set(base))
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    expected = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    assert all(got.get(i, i) == c for i, c in expected.items())


def test_simhash_awkward(spark, docs):
    rows = simhash.components(docs).collect()
    assert len(rows) == len(AWKWARD) and {r["id"]: r["component_id"] for r in rows if r["fp"] == 0} == {1: 1, 2: 1, 3: 1}
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 8), (True, 0)]
    assert simhash.near_dedup(docs.where("false")).count() == 0 and simhash.components(docs.where("false")).count() == 0


def test_near_dedup_finds_similar_texts(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        words = [vocabulary[k] for k in rng.integers(0, 4000, 300)]
        rows.append((2 * i, " ".join(words)))
        for at in rng.integers(0, 300, 3):
            words[at] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(60)} <= kept and len(kept) <= 62


def test_quality_counts_match_brute_force(spark, real, docs):
    for rows in (real, docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        got = {r["doc_id"]: r for r in quality.document_statistics(rows).collect()}
        for i, text in texts(rows).items():
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
            covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
            assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected


def test_quality_list_learns_a_planted_rule(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some plain words in a row that are quite all right here "), F.when(F.col("id") % 5 == 0, F.repeat(F.lit("x!!! "), 8)).otherwise(F.concat(F.lit("and w"), "id"))).alias("text"))
    labels = rows.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    rules = quality.learn(quality.document_statistics(rows), labels)
    assert rules and quality.good_documents(rows, labels).count() == 2400
    assert quality.good_documents(rows, labels).columns == rows.columns
    assert quality.learn(quality.document_statistics(rows), labels.where("quality = 1")) == []


def test_quality_awkward(spark, docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.good_documents(docs.where("false"), labels).count() == 0


def test_licenses(spark, docs):
    notice, words = licenses.LICENSES["MIT"], licenses.LICENSES["MIT"].split()
    cut = " ".join(w for i, w in enumerate(words) if i % 12)
    rows = [(1, "Before. " + notice + " After"), (2, "x " * 500 + cut + " y" * 500), (3, " ".join(words[::-1])), (4, "Released under the MIT License.\n" * 2), (5, "under the license the software is of no use to the person"), (6, None), (7, "")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0]["name"] == "MIT" and got[1][0]["coverage"] == 1.0 and rows[0][1][got[1][0]["begin"] : got[1][0]["end"]] == notice.rstrip(".")
    assert got[2][0]["name"] == "MIT" and 0.8 <= got[2][0]["coverage"] < 1
    assert got[4][0]["name"] == "MIT (notice)" and got[4][0]["begin"] == 0
    assert not got[3] and not got[5] and not got[6] and not got[7]
    assert licenses.scan(docs).count() == len(AWKWARD) and licenses.scan(docs.where("false")).count() == 0


def test_patience_alignment_is_a_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ([str(x) for x in rng.integers(0, 12, rng.integers(0, 25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


WORD_BPE = P.path("word_bpe_49k.json")


def test_token_counts_match_the_library(spark, real, docs):
    library = Tokenizer.from_file(WORD_BPE)
    for rows in (real, docs.where("doc_id is not null")):
        got = {r["doc_id"]: r for r in tokencount.token_counts(rows, WORD_BPE, 2048).collect()}
        for i, text in texts(rows).items():
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(text.encode()), n > 2048)
            fits = got[i]["chars_in_limit"]
            assert len(library.encode(text[:fits], add_special_tokens=False).ids) <= 2048 and (n > 2048 or fits == len(text))


def test_every_prefix_matches_the_library(spark):
    library = Tokenizer.from_file(WORD_BPE)
    text = "Don't stop: naïve 'reality' 1234 中文字 ÅÉ <|endoftext|>x thtionandering"
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = tokencount.prefix_token_counts(rows, WORD_BPE)
    stored = {r["doc_id"]: r["prefix_tokens"] for r in got.collect()}
    assert stored[1] == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)] and stored[2] == [0]
    r = got.where("doc_id = 1").select(tokencount.tokens_of_prefix(F.col("prefix_tokens"), F.lit(10)).alias("n"), tokencount.chars_within(F.col("prefix_tokens"), F.lit(7)).alias("c")).first()
    assert r["n"] == stored[1][10] and r["c"] == max(i for i, n in enumerate(stored[1]) if n <= 7)


def test_embeddings_match_brute_force(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = v.collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(rows[i]["vec_id"], rows[j]["vec_id"]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1))) if rows[i]["label"] == rows[j]["label"]]
    n = Counter(i for pair in links for i in pair)
    expected = brute_components([r["vec_id"] for r in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(v).collect()}
    assert got == {i: (n[i], c, i == c) for i, c in expected.items()}


def test_embeddings_recall_near_the_threshold_and_blocks(spark, monkeypatch):
    """Pairs of cosine just over 0.98 are found, and large cells are compared in blocks with the same counts."""
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((200, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((200, 32))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.9805 * base + np.sqrt(1 - 0.9805**2) * side
    crowd = base[0] + 0.01 * rng.standard_normal((40, 32))
    x = np.concatenate([base, near, crowd, crowd[:3]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(rows).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= expected).all() and found.sum() >= 0.99 * expected.sum()


def test_embeddings_awkward(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("theirs"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), None: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}}
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_e8_points():
    y = np.random.default_rng(7).standard_normal((300, 8)) * 3
    p = embeddings.nearest_e8(y)
    assert ((2 * p) % 1 == 0).all() and ((p.sum(axis=1) % 2) == 0).all() and len(embeddings.roots()) == 240
    near = ((y - p) ** 2).sum(axis=1)
    assert all((((y - (p + r)) ** 2).sum(axis=1) >= near - 1e-9).all() for r in embeddings.roots())


BYTE_BPE = P.path("byte_bpe_50k.json")


def test_packing(spark, real, docs):
    library = Tokenizer.from_file(BYTE_BPE)
    for rows in (real, docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        pieces = packing.pack_documents(rows, BYTE_BPE, P.PATTERN).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_doc[p["doc_id"]].append(p)
            by_sequence[p["sequence_id"]].append(p)
        for i, text in texts(rows).items():
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
                at += p["length"]
            assert at == len(ids)
        waste = 0
        for own in by_sequence.values():
            own.sort(key=lambda p: p["offset"])
            total = sum(p["length"] for p in own)
            assert [p["offset"] for p in own] == list(np.cumsum([0, *[p["length"] for p in own]])[:-1]) and total <= 1024 and len(own) <= 64
            waste += 0 if total & (total - 1) == 0 else 1024 - total
        assert waste <= 0.01 * sum(p["length"] for p in pieces)
    assert packing.pack_documents(docs.where("false"), BYTE_BPE, P.PATTERN).count() == 0


def test_packing_conversations_keeps_all_limits(spark):
    """Tokens, segments and loss-bearing tokens of each sequence; each id of each conversation in exactly one piece."""
    library = Tokenizer.from_file(BYTE_BPE)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    whole = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r["turn"], r["role"], r["text"])):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        whole[r["conv_id"]] += [(i, r["role"] == "assistant") for i in ids]
    pieces = packing.pack_conversations(turns, BYTE_BPE, P.PATTERN, tokens=512, segments=4, loss=100).collect()
    sequences, docs, tight = defaultdict(list), defaultdict(list), 0
    for p in pieces:
        own = whole[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array([i for i, _ in own], dtype="<u4").tobytes()) and p["doc_tokens"] == len(whole[p["doc_id"]])
        sequences[p["sequence_id"]].append((p["offset"], p["length"], sum(bears for _, bears in own)))
        docs[p["doc_id"]].append((p["start"], p["length"]))
    for own in sequences.values():
        loss = sum(x for _, _, x in own)
        assert sum(n for _, n, _ in own) <= 512 and len(own) <= 4 and loss <= 100
        tight += loss > 80
        assert [at for at, _, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n, _ in sorted(own)]])[:-1])
    assert tight  # the limit on loss decides somewhere
    for i, ids in whole.items():
        assert [at for at, _ in sorted(docs[i])] == list(np.cumsum([0, *[n for _, n in sorted(docs[i])]])[:-1]) and sum(n for _, n in docs[i]) == len(ids)


def test_toxicity(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.1").cache()
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = got.join(marks, "doc_id").where("held_out").toPandas()
    order = scored.sort_values("score").reset_index(drop=True)
    ranks_ = order.index[order.toxic == 1] + 1
    n1, n0 = (order.toxic == 1).sum(), (order.toxic == 0).sum()
    assert (ranks_.values.sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.8
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_awkward(spark, docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    chain = toxicity.learn(docs, labels)
    tagged = toxicity.tag(docs, chain)
    assert tagged.count() == len(AWKWARD) and tagged.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.without_toxic(docs, chain).columns == docs.columns
    empty = toxicity.learn(docs.where("false"), labels.where("false"))
    assert {r["score"] for r in toxicity.tag(docs, empty).collect()} == {0.0} and toxicity.tag(docs.where("false"), empty).count() == 0


def test_marginals_match_brute_force():
    rng = np.random.default_rng(8)
    chain = toxicity.Chain({"=a": 1}, np.array([-1.0, 2.0]), rng.standard_normal((2, 2)), 0.3)
    for n in (0, 1, 2, 7):
        f = rng.integers(0, 2, n)
        total, one = 0.0, np.zeros(n)
        for k in range(2**n):
            y = [k >> i & 1 for i in range(n)]
            w = np.exp(sum(chain.emit[f[i]] * y[i] for i in range(n)) + sum(chain.move[y[i], y[i + 1]] for i in range(n - 1)) + (chain.start * y[0] if n else 0))
            total += w
            one += w * np.array(y)
        got = chain.marginals([f, np.zeros(3, np.int64)])[0]
        assert np.allclose(got, one / total if n else [])


def test_bpe_round_trip(spark, real, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    for rows in (real, docs.where("doc_id is not null")):
        got = {r["doc_id"]: r for r in bpe.round_trip(rows, path, P.PATTERN).collect()}
        for i, text in texts(rows).items():
            ids = library.encode_ordinary(text)
            assert got[i]["n_tokens"] == len(ids) and got[i]["exact"] and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
            assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    coded = bpe.encode(docs, path, P.PATTERN)
    assert all(r["byte_ends"][-1:] in ([], [len((t or "").encode())]) for r, (_, t, _) in zip(coded.collect(), AWKWARD))
    assert sorted(bytes(r["decoded"]) for r in bpe.decode(coded, path, P.PATTERN).collect()) == sorted((t or "").encode() for _, t, _ in AWKWARD)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")
    r = queries.op10_language(spark, sf).join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).first()
    assert r["right"] > 0.97


def test_language_awkward(spark, docs):
    filters = langid.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, filters).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("de", "en", "fr")
    assert langid.learn(docs.where("false")) is None and {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_bloom_filters_hold_what_was_put_in():
    rng = np.random.default_rng(9)
    grams = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    masks = rng.integers(1, 8, len(grams)).astype(np.uint64)
    f = langid.Filters.of(["a", "b", "c"], grams, masks[None], "a", 3, 16)
    assert ((f.masks(grams)[0] & masks.astype(f.slots.dtype)) == masks.astype(f.slots.dtype)).all()
    others = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
    rate = np.array([((f.masks(others)[0] >> np.uint16(i)) & 1).mean() for i in range(3)])
    assert np.allclose(rate, f.false_rate, atol=0.005)


def test_folds(spark):
    got = {r["doc_id"]: r["f"] for r in spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", fold("doc_id", 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_pipeline(spark):
    """Stages are chained by hand; each keeps the documents' columns, and clean documents stay."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "line dedup", "simhash near-dedup", "packing"]
    from evalgrove.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()}


def five_word_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def jaccard(a, b):
    a, b = five_word_shingles(a), five_word_shingles(b)
    return len(a & b) / len(a | b)


def test_near_dedup_keeps_texts_under_the_similarity(spark):
    """Pairs of similarity 0.65 to 0.95: just those of 0.8 or more lose a document."""
    rng = np.random.default_rng(12)
    rows, expected = [], set()
    for i in range(300):
        words = [f"w{k}" for k in rng.integers(0, 100_000, 30 if i % 3 else 200)]
        other = list(words)
        for at in rng.integers(0, len(words), 1 if i % 3 else rng.integers(1, 9)):
            other[at] = "changed"
        if i % 3 == 1:
            other = [*words[:-3], "x", "y", "z"]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        expected |= {2 * i} | ({2 * i + 1} if jaccard(rows[-2][1], rows[-1][1]) < 0.8 else set())
    assert 350 < len(expected) < 590
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == expected


def test_exact_similarity_links_match_brute_force():
    rng = np.random.default_rng(13)
    for side in (None, rng.integers(0, 2, 60)):
        sets = [np.unique(rng.choice(12, rng.integers(0, 12))).astype(np.uint64) for _ in range(60)]
        own = [set(s.tolist()) for s in sets]
        linked = [(i, j) for i in range(60) for j in range(i) if (not own[i] and not own[j]) or ((side is None or side[i] != side[j]) and own[i] | own[j] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]))]
        assert simhash.jaccard_roots(sets, 0.8, side).tolist() == list(brute_components(range(60), linked).values())


def test_pairs_at_the_similarity_meet_in_tables_of_any_size():
    """Filing takes nothing but the text itself, and pairs of similarity 0.8 share a key and enough bits."""
    rng = np.random.default_rng(14)
    met = 0
    for i in range(1500):
        n = (1, 5, 30)[i % 3]
        union = rng.integers(0, 2**64, 10 * n, dtype=np.uint64)
        a, b = np.sort(union[: 9 * n]), np.sort(union[n:])
        bits = np.bitwise_count(simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)).sum()
        met += bits <= simhash.WIDE_BITS and (simhash.filing_keys(a) == simhash.filing_keys(b)).any()
    assert met >= 0.998 * 1500


def test_licenses_that_a_text_repeats(spark):
    """Copies close together, in mid-text, whole and with a changed word; the first one counts."""
    short, apache = "Released under the MIT License.", licenses.LICENSES["Apache-2.0"]
    rows = [
        (f"alpha beta {short} {short} gamma", short), (f"one {short} a few words between {short} end", short), (f"x {short}\n{short}\n{short} y", short),
        (f"alpha {apache} and {apache} omega", apache), (f"alpha {apache} {'word ' * 40} {apache} omega", apache),
        (f"alpha {apache.replace('may not', 'cannot')} {apache.replace('obtain', 'get')} omega", None), ("alpha Released under this MIT License. Released under this MIT License. omega", None),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    for i, (text, whole) in enumerate(rows):
        assert got[i] and got[i][0]["coverage"] >= 0.8
        if whole:
            best = next(x for x in got[i] if x["matched"] == len(re.findall(r"[^\W_]+", whole)))
            assert best["coverage"] == 1.0 and (best["begin"], best["end"]) == (text.index(whole), text.index(whole) + len(whole.rstrip(".")))


def test_rows_without_an_id_and_texts_of_one_id_keep_their_content(spark):
    common = "a line that is common to some documents"
    rows = [
        (1, f"{common}\nfirst of one, and only there"), (None, f"{common}\nthe first line of a null id"), (None, f"some other first line\n{common}\nthe second null id"),
        (7, f"{common}\nseventh document, one text"), (7, f"words of the other text\n{common}"), (7, f"words of the other text\n{common}"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in linededup.line_dedup(df).collect())
    assert got == {
        (1, rows[0][1], 0): 1, (None, "the first line of a null id", 1): 1, (None, "some other first line\nthe second null id", 1): 1,
        (7, "seventh document, one text", 1): 1, (7, "words of the other text", 1): 2,
    }
    long = [" ".join(f"w{k}" for k in np.random.default_rng(i).integers(0, 9999, 60)) for i in range(4)]
    rows = [(1, long[0]), (None, long[0]), (None, long[1]), (None, long[2]), (7, long[3]), (7, long[0] + " end"), (7, long[1] + " end"), (7, long[3])]
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == Counter({(1, long[0]): 1, (None, long[2]): 1, (7, long[3]): 1, (7, long[1] + " end"): 1})


def test_embeddings_without_an_id_each_count(spark):
    rows = [(1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, [0.0, 2.0], 1), (None, [-1.0, 0.0], 1), (None, None, 1), (5, [1.0, 1.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    count = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got)
    assert count == Counter({(1, 2, 1, True): 1, (None, 2, 1, False): 1, (None, 1, None, True): 1, (None, 1, None, False): 1, (None, 0, None, True): 2, (5, 0, 5, True): 1, (5, 2, 1, False): 1})


CHUNKS = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\xa0", "　", "\x1c", "\x85", "foo", "Bar", "naïve", "'s", "'re", "'", "it's", "'LL", "123", "4", "!!", "#$", "中文字", "ÄÖ", "<|endoftext|>", "<|end", "é", "e\u0301", "\u0323\u0301", "👍🏽", "ß", "ǅ", "İ", "ʰ",
          "\u0323", "x", "Ⅷ", "²", "\ufeff", "\u200b", "กำลัง", "ก็", "한국", "\u1112\u1161\u11ab", "\u1100", "\u1161", "ि", "क्ष", "thtionandering", "Σ", "ς", "ﬁ", "A\u030a", "ﷺ"]


def some_texts(seed, n, most=9):
    rng = np.random.default_rng(seed)
    return ["".join(CHUNKS[k] for k in rng.integers(0, len(CHUNKS), rng.integers(0, most + 1))) for _ in range(n)]


def test_prefix_counts_and_longest_prefixes_of_all_scripts():
    library, count = Tokenizer.from_file(WORD_BPE), tokencount.PrefixCounter(WORD_BPE)
    for text in some_texts(21, 1500):
        expected = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert count.every_prefix(text) == expected and sum(count.counts(text)) == expected[-1]
        for budget in (0, 1, 3, 6):
            assert count.longest_prefix(text, budget) == max(i for i, n in enumerate(expected) if n <= budget)


def test_prefixes_of_a_repeated_chunk_are_counted_once(monkeypatch):
    """Counts inside of chunks are remembered, and are the same as by the library, at the first and at later places."""
    library, count, asked = Tokenizer.from_file(WORD_BPE), tokencount.PrefixCounter(WORD_BPE), Counter()
    for held in (count.insides, count.runs):
        monkeypatch.setattr(held, "count", lambda text, own=held.count: (asked.update([text]), own(text))[1])
    text = " Ontieshtandre, naïveté! it's 12\u3000don't\n Ontieshtandre." + "ﷺ" * 40
    expected = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    for _ in range(3):
        assert count.every_prefix(text) == expected
    assert max(n for t, n in asked.items() if len(t) <= tokencount.CACHE_CHARS) == 1 and asked["ontieshtandre"] == 1


def test_prefix_counts_with_a_budget(spark):
    rows = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "")], "doc_id long, text string")
    got = tokencount.prefix_token_counts(rows, WORD_BPE, budget=2)
    for r in got.select("*", tokencount.chars_within(F.col("prefix_tokens"), F.lit(2)).alias("c")).collect():
        assert (r["n_tokens"], r["chars_in_limit"]) == (r["prefix_tokens"][-1], r["c"])


def test_borders_between_tokens_match_plain_merging():
    count, rng = tokencount.PrefixCounter(WORD_BPE), np.random.default_rng(22)
    tokens = sorted(t for t in count.vocab if len(t) < 7)
    solid = [t for t in (tokens[k] for k in rng.integers(0, len(tokens), 3000)) if count.pairs["", t]]
    for left, right in zip(solid, solid[1:]):
        if not left.endswith(count.end):
            assert count.compatible(left, right) == (count.merged([*left, *count.symbols(right)]) == [left, right])


@pytest.mark.parametrize("text", ["的一是不了人我在有他" * 33_000, "กำลังมาที่นี่เพื่อ" * 20_000, "<|" * 500_000, "<|endoftext|>" * 77_000, "a" * 1_000_000])
def test_long_texts_without_spaces_are_counted_in_time(text):
    library, count = Tokenizer.from_file(WORD_BPE), tokencount.PrefixCounter(WORD_BPE)
    began = time.process_time()
    fits = count.longest_prefix(text, 2048)
    assert time.process_time() - began < 15
    assert len(library.encode(text[:fits], add_special_tokens=False).ids) <= 2048 < len(library.encode(text[: fits + 16], add_special_tokens=False).ids)


def test_byte_level_encodings_of_odd_texts():
    library, path = Tokenizer.from_file(BYTE_BPE), P.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    packs, plain = packing.encoder(BYTE_BPE, P.PATTERN), bpe.encoder(path, P.PATTERN)
    for text in some_texts(23, 20_000, 12):
        assert packs.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert plain.encode(text) == np.array(other.encode_ordinary(text), dtype="<u4").tobytes()


def test_licenses_with_foreign_words_match_whole_alignment():
    """Texts of a template with up to 2,000 words put in at random places: what aligning all words finds is found."""
    rng = np.random.default_rng(24)
    made = [licenses.Template(*t) for t in (licenses.LICENSES | licenses.NOTICES).items()]
    for _ in range(150):
        t = made[rng.integers(0, len(made))]
        words = list(t.words)
        for _ in range(rng.integers(0, 4)):
            at, n = rng.integers(0, len(words) + 1), rng.integers(0, 2001)
            words[at:at] = [("the", "of", "software", "x")[k % 4] if k < 40 and n % 3 == 0 else f"x{k}" for k in rng.integers(0, 500, n)]
        whole = len(licenses.align(words, t.words)) / len(t.words)
        places = defaultdict(list)
        for i, w in enumerate(words):
            places[w].append(i)
        found = t.find(places, 0.8)
        assert (found[0] if found else 0) >= (whole if whole >= 0.8 else 0)
        if found:  # aligned words are a common subsequence, so no more than the longest one
            assert found[0] <= 1 and t.words[0] in words


def test_licenses_far_apart_copies_each_found():
    t = licenses.Template("MIT", licenses.LICENSES["MIT (permission)"])
    words = []
    for k in range(3):
        words += [f"z{i % 9}" for i in range(50)] + t.words[:20] + [f"z{i % 7}" for i in range(200)] + t.words[20:]
    places = defaultdict(list)
    for i, w in enumerate(words):
        places[w].append(i)
    assert t.find(places, 0.8)[0] == 1.0


def test_line_dedup_in_parts_and_with_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PROBES", 50)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the same line everywhere\nown line number "), F.col("id")).alias("text"))
    for c in ("n_lines", "N_DROPPED", "line_dedup_row", "line_dedup_gone", "line_dedup_lines"):
        rows = rows.withColumn(c, F.lit("theirs"))
    got = linededup.line_dedup(rows)
    assert got.columns == [*rows.columns, "n_lines_", "n_dropped_"]
    r = got.agg(F.sum("n_dropped_").alias("n"), F.min_by("n_dropped_", "doc_id").alias("first"), F.count_if(F.col("line_dedup_row") == "theirs").alias("theirs")).first()
    assert tuple(r) == (2999, 0, 3000)
    assert linededup.line_dedup(rows, counts=False).columns == rows.columns
    assert linededup.line_dedup(rows, least_copies=3001).agg(F.sum("n_dropped_")).first()[0] == 0


def test_near_dedup_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words in this one text", "z")], "doc_id long, text string, near_dedup_id string").withColumn("near_dedup_text", F.lit("theirs"))
    assert sorted(map(tuple, simhash.near_dedup(rows).collect())) == [(1, "a b c d e f g", "x", "theirs"), (3, "other words in this one text", "z", "theirs")]


def test_near_dedup_recall_against_brute_force(spark, real):
    """Over real rows and copies with changed words: the documents that exact similarity of all pairs would drop."""
    rng, own = np.random.default_rng(25), {i: t for i, t in texts(real).items() if 30 < len(t.split()) < 400}
    rows = list(own.items())
    for i, t in list(own.items())[:120]:
        words = t.split()
        for at in rng.integers(0, len(words), max(1, len(words) // 80)):
            words[at] = "changed"
        rows.append((10_000 + i, " ".join(words)))
    sets = {i: five_word_shingles(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a]) >= 0.8 * len(sets[b]) and len(sets[b]) >= 0.8 * len(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = {i for i, c in brute_components(sets, linked).items() if i != c}
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = set(sets) - kept
    assert gone <= expected and len(gone) >= 0.98 * len(expected) and len(expected) > 60


def test_near_dedup_takes_candidates_from_pivot_tables(spark, monkeypatch):
    """Classes of fingerprints at distance 2 or less are connected by the tables of distances, and the stage asks these."""
    rng, asked = np.random.default_rng(31), []
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 30)]
    fps = [b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (4, 2))] + base + base[:5]
    edges = simhash.pivot_candidates(spark.createDataFrame(list(enumerate(fps)), "cls long, fp long"))
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    expected = brute_components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2])
    assert {i: got.get(i, i) for i in range(len(fps))} == expected
    monkeypatch.setattr(simhash, "links", lambda fps, own=simhash.links: (asked.append(fps.count()), own(fps))[1])
    text = " ".join(f"w{i}" for i in range(50))
    kept = simhash.near_dedup(spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and asked == [3]


def test_toxicity_works_on_bounded_slices():
    texts = ["a" * 700_000, None, "b" * 700_000, "c" * 3_000_000, "", "d"]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(toxicity.slices([batch], 1))
    assert [x for part in parts for x in part.column(0).to_pylist()] == list(range(6))
    assert [part.num_rows for part in parts] == [2, 1, 1, 2] and not list(toxicity.slices([batch.slice(0, 0)], 1))


def test_quality_verdicts_match_brute_force(spark):
    """base_failed by its rule, and kept by the learned list, read off its thresholds in plain Python."""
    sf = "/root/testdata/sf0.01"
    statistics = quality.document_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    rules = quality.learn(statistics, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rules
    for r in quality.judged(statistics, rules).collect():
        def share(a, b):
            return r[a] / r[b] if r[b] else 0.0

        x = {"words": r["n_words"], "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
             "variety": share("n_unique_words", "n_words"), "marks": share("n_marks", "word_chars"), "upper": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars")}
        fails = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        hit = next((k for k, rule in enumerate(rules, 1) if all((x[l.feature] > l.threshold) == l.above for l in rule)), None)
        assert (r["base_failed"], r["rule"], r["kept"]) == (fails, hit, not fails and hit is None)


def test_toxicity_scores_match_brute_force():
    """Score of a text from its tokens' probabilities, summed over all labellings."""
    chain = toxicity.Chain({"=bad": 1, "^awfu": 2}, np.array([-2.0, 3.0, 1.0]), np.array([[0.5, -0.7], [-0.2, 0.4]]), -0.3, curve=np.array([0.4, 0.7, 1.1, -0.5]))
    for text in ("", "good bad, words", "awful bad", "so (awfully) it was"):
        f = [{"bad": 1, "awful": 2, "awfully": 2}.get(w.strip("(),"), 0) for w in text.split()]
        total, one = 0.0, np.zeros(len(f))
        for k in range(2 ** len(f)):
            y = [k >> i & 1 for i in range(len(f))]
            w = np.exp(sum(chain.emit[a] * b for a, b in zip(f, y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:])) + (chain.start * y[0] if y else 0))
            total, one = total + w, one + w * np.array(y)
        p = one / total if f else one
        top = np.clip(p.max(initial=1e-4), 1e-4, 1 - 1e-4)
        x = np.array([1, np.log(top / (1 - top)), np.log1p(p.sum()), np.log1p(len(f)) * 0.1])
        assert chain.scores([text])[0][0] == pytest.approx(1 / (1 + np.exp(-x @ chain.curve)))


def test_language_decisions_match_brute_force(spark):
    """Every text's language by counting its n-grams in plain sets, corrected by the filters' measured rates."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    filters = langid.learn(rows, bits_per_gram=64)  # few false positives
    own = texts(rows)
    held = {}
    for l in range(len(filters.languages)):
        grams = np.unique(np.concatenate([langid.ngrams([t])[0] for t in own.values()]))
        held[l] = set(grams[(filters.masks(grams)[0] >> filters.slots.dtype.type(l)) & filters.slots.dtype.type(1) > 0].tolist())
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows, filters).collect()}
    for i, t in own.items():
        grams = langid.ngrams([t])[0].tolist()
        rate = filters.false_rate
        true = [max(0.0, (sum(g in held[l] for g in grams) - len(grams) * rate[l]) / (1 - rate[l])) for l in held]
        if not any(c.isalpha() for c in t):
            assert got[i] == "und"
        elif max(true) > 0:
            assert got[i] == filters.languages[true.index(max(true))]
        else:
            assert got[i] == filters.usual


def test_more_languages_than_bits_of_a_word(spark):
    """80 languages of a word each; texts are told apart, and repeated rows and very long texts decided alike."""
    words = ["".join(chr(97 + (7 * k + 3 * j * (k % 5 + 1)) % 26) for j in range(9)) for k in range(80)]
    rows = [(100 * k + j, f"{w} {w} {w}", f"l{k:02}") for k, w in enumerate(dict.fromkeys(words)) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.learn(df)
    assert len(filters.slots) == 2
    asked = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, t) for i, t, _ in rows[:5]] + [(1, rows[0][1] * 20_000)], "doc_id long, text string")
    wrong = {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, filters).collect()}
    assert sum(wrong[i] == l for i, _, l in rows) >= 0.95 * len(rows)


def test_pipeline_on_awkward_tables(spark, docs, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table through all stages."""
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (None, 0, 1), (5, None, None), (20, 1, 0), (21, 1, 0)], "doc_id long, quality int, toxic int")
    clean = "a clean text of more than ten words that no rule has to reject, ever"
    clashing = docs.unionByName(spark.createDataFrame([(20, clean), (None, clean), (21, clean + " and more of it")], "doc_id long, text string"), allowMissingColumns=True)
    for c in ("n_lines", "n_dropped", "line_dedup_row", "near_dedup_id", "quality_rules_words"):
        clashing = clashing.withColumn(c, F.lit("theirs"))
    for name, rows in (("some", clashing), ("none", clashing.where("false"))):
        sf = f"file://{tmp_path}/{name}"
        rows.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        held = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, held, sf).columns == held.columns
        got = corpus_pipeline.run(spark, sf).collect()
        assert bool(got) == (name == "some") and {r["doc_id"] for r in got} <= {20, 21, *(r[0] for r in AWKWARD)}
