"""Readers: what they take, skip and refuse; streaming."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalgrove.functions import replies, rules
from evalgrove.operators import conversations, lint, retrieval
from evalgrove.sources import traces
from evalgrove.storage import new_folder
from evalgrove.streaming import jobs


def lines(spark, *text):
    path = new_folder(spark, "test")
    spark.createDataFrame([(t,) for t in text], "value string").coalesce(1).write.text(path)
    return path


def test_trace_keeps_order_and_nulls(spark):
    path = lines(spark, *[json.dumps({"run_id": "r", "item_id": "i", "role": "user", "content": str(k)}) for k in range(5)], "")
    rows = traces.read_trace(spark, path).orderBy("seq").collect()
    assert [r["content"] for r in rows] == list("01234") and rows[0]["cached"] is None


def test_malformed_trace_line_is_an_error(spark):
    with pytest.raises(Exception, match="malformed line"):
        traces.read_trace(spark, lines(spark, '{"run_id": "r"}', "{oops")).collect()


def test_unknown_item_field_is_an_error(spark):
    with pytest.raises(Exception, match="colour"):
        traces.read_items(spark, lines(spark, '{"id": "a", "colour": 1}')).collect()


def test_empty_dataset_is_an_error(spark):
    with pytest.raises(Exception, match="empty"):
        traces.read_items(spark, lines(spark, "")).collect()


def test_labels_skip_bad_lines(spark):
    ok = {"item_id": "a", "run_id": "r", "label": "pass", "seconds_spent": 1.0}
    path = lines(spark, json.dumps(ok), "{", json.dumps(ok | {"score": 3}), json.dumps(ok | {"label": "maybe"}))
    assert traces.read_labels(spark, path).count() == 1


def test_pair_scored_twice_is_an_error(spark):
    with pytest.raises(Exception, match="scored twice"):
        traces.read_scores(spark, lines(spark, '{"pair_id": "a"}', '{"pair_id": "a"}')).collect()


def test_manifests_and_problems(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.manifest.json").write_text('{"run_id": "a",\n "started_at": "2024"}')
    (tmp_path / "sub" / "b.manifest.json").write_text('{"run_id": "b", "started_at": "2025"}')
    (tmp_path / "c.manifest.json").write_text("nonsense")
    good, bad = traces.read_manifests(spark, f"file://{tmp_path}")
    assert [r["run_id"] for r in good.collect()] == ["b", "a"] and bad.count() == 1


def test_aliases_and_errors(spark):
    rows = spark.createDataFrame([("1", "q", "", "a", "4", "x"), ("2", None, "q2", "a", "9", "x"), ("3", "q", "", "a", "z", "x")], "id string, prompt string, question string, answer string, label string, extra string")
    got = {r["pair_id"]: r for r in traces.labelled_pairs(traces.with_aliases(rows)).collect()}
    assert got["2"]["prompt"] == "q2" and got["1"]["metadata"] == {"extra": "x"}
    assert [got[k]["errors"] for k in "123"] == [[], ["score isn't whole from 1 to 5"], ["no score"]]
    with pytest.raises(ValueError):
        traces.mapped_columns(rows, {"nothing": "id"})


def test_judge_runs(spark):
    m = spark.createDataFrame([("r1", "eval", None), ("r2", "eval", None), ("j1", "judge", "x/r1.jsonl"), ("j2", "judge", "r2.jsonl"), ("j3", "judge", "r2.jsonl")], "run_id string, run_kind string, pairs_path string")
    one, many = traces.judge_runs(m)
    assert [tuple(r) for r in one.collect()] == [("r1", "j1")] and [r["run_id"] for r in many.collect()] == ["r2"]


def test_corpus(spark, tmp_path):
    for name in ("a.md", "b.md", "README.md", "c.txt"):
        (tmp_path / name).write_text(name)
    assert sorted(r["name"] for r in traces.read_corpus(spark, f"file://{tmp_path}", ["README.md"]).collect()) == ["a.md", "b.md"]


def test_composed_corpus_refuses_collisions(spark):
    a, b = (spark.createDataFrame([(x,)], "name string") for x in ("a", "b"))
    assert retrieval.composed(a, b, "name").count() == 2
    for other in (a, b.where("false")):
        with pytest.raises(Exception, match="collide"):
            retrieval.composed(a, other, "name").collect()


def test_chunks():
    text = "# One\n\nfirst block\n\nsecond\n\n## Two\n\n```\n# no heading\n\nstill code\n```\n\n" + "A sentence here. " * 100
    chunks = retrieval.chunk_text(text)
    assert chunks[0][0] == ("One",) and "first block\n\nsecond" == chunks[0][1]
    assert any("still code" in c[1] for c in chunks) and all(c[0] == ("One", "Two") for c in chunks[1:])
    assert all(n <= retrieval.MOST_TOKENS for _, _, n in chunks) and retrieval.chunk_text("") == []


def test_top_k_ties_and_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    assert [(r["chunk_id"], r["place"]) for r in retrieval.top_k(v.where("id = 1"), v, 2).orderBy("place").collect()] == [(1, 1), (2, 2)]
    assert retrieval.top_k(v.where("id = 1"), v, 0).count() == 0
    assert retrieval.top_one(v.where("id = 3"), v.where("id < 3"), 0.5).first()["score"] == 0.0


REPLIES = {
    '{"tool": "t", "args": {"a": 1}}': ("tool", None), 'so\n```json\n{"final": "x", "citations": []}\n```': ("final", None), "hello": ("violation", "unparseable_json"), '{"a": 1}': ("violation", "unknown_top_level_key"),
    '{"final": 1}': ("violation", "wrong_value_type"), '{"final": "x"}': ("violation", "missing_citations_key"), '{"final": "x", "citations": [1]}': ("violation", "citations_wrong_type"), 'I say {"final": "x", "citations": ["c"]} now': ("final", None),
}


def test_replies(spark):
    rows = spark.createDataFrame([(t,) for t in REPLIES], "t string").select("t", replies.parse_reply(F.col("t")).alias("r"))
    assert {r["t"]: (r["r"]["kind"], r["r"]["violation"]) for r in rows.collect()} == REPLIES


def test_rules(spark):
    rows = spark.createDataFrame([("I can't help with this. It might, you might want to, vary",), (None,)], "t string")
    got = rows.select(rules.matches_any(F.col("t"), rules.RULES["refusal"]).alias("m"), rules.first_match(F.col("t"), rules.RULES["refusal"]).alias("f"), rules.hedging_count(F.col("t")).alias("h")).collect()
    assert [tuple(r) for r in got] == [(True, "I can't help", 2), (False, None, 0)]
    one = spark.createDataFrame([("Claude-3 and  GPT said", "one  two")], "a string, b string").select(rules.redacted(F.col("a")).alias("r"), rules.redactions(F.col("a")).alias("n"), rules.word_count(F.col("a")).alias("w")).first()
    assert tuple(one) == ("[model] and  [model] said", 2, 4)


def test_lint(spark):
    got = lint.diagnostics(spark.createDataFrame([(1, "{}"), (2, "x"), (3, "[1]"), (4, '{"a":1,"a":2}'), (5, " ")], "i int, v string"), ["i"], lint.line_problems(F.col("v"))).collect()
    assert sorted((r["i"], r["code"]) for r in got) == [(2, "not_json"), (3, "not_object"), (4, "duplicate_key"), (5, "blank_line")]
    files = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"\xef\xbb\xbf{}\r\n")), (3, bytearray(b"a"))], "i int, c binary")
    assert sorted((r["i"], r["code"]) for r in lint.diagnostics(files, ["i"], lint.file_problems(F.col("c"))).collect()) == [(1, "empty_file"), (2, "byte_order_mark"), (2, "crlf"), (3, "no_final_newline")]


def test_chain(spark):
    s = spark.createDataFrame([(1, None, 2), (2, 1, 3), (3, 2, 1), (9, None, 4)], "run_id long, previous_run_id long, n_turns long")
    assert sorted(map(tuple, conversations.chain_turns(s).collect())) == [(3, 3, 6), (9, 1, 4)]
    assert conversations.missing_links(s.where("run_id <> 1")).count() == 1


def test_watermark_matches_closed_windows(spark):
    rows = spark.createDataFrame([(f"2024-01-0{d} 05:00:00", d, d % 2 == 0) for d in range(1, 6)], "ts string, k int, flag boolean").withColumn("ts", F.to_timestamp("ts"))
    path = new_folder(spark, "windows")
    stream = jobs.windowed_rates(jobs.as_stream(spark, rows.repartition(1), 1), "ts", [], F.col("flag")).select("window.start", "n")
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/rows")
    q.awaitTermination()
    assert spark.read.parquet(f"{path}/rows").count() == 4  # the last window is still open


def test_items_are_told_once_and_forgotten(spark):
    """Repeated and unordered rows, items that never end, and state that goes with the watermark."""
    start = 1_700_000_000
    batches = [[("a", 1, "turn", 0), ("b", 0, "turn", 1), ("c", 0, "user", 2)], [("a", 1, "turn", 3), ("a", 0, "turn", 4), ("b", 1, "turn", 5), ("z", 0, "turn", 6)], [("c", 0, "user", 90_000)], [("c", 0, "turn", 90_001)], [("a", 1, "turn", 90_002)]]
    path = new_folder(spark, "turns")
    kind = "item_id string, turn_idx int, role string, ts timestamp"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(a, t, r, s) for a, t, r, s in rows], "item_id string, turn_idx int, role string, s long")
        df.select("item_id", "turn_idx", "role", F.timestamp_seconds(start + F.col("s")).alias("ts")).coalesce(1).write.parquet(f"{path}/{i}")
    items = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("never", 3)], "item_id string, n_turns int")

    def run(idle_ms):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
        found = jobs.completions(stream, items, ["item_id"], "ts", "turn_idx", "turn", late="1 hour", idle_ms=idle_ms)
        return sorted(r["item_id"] for r in jobs.appended_result(spark, found).collect())

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert run(10**9) == ["a", "b", "c"]
    assert run(1000) == ["a", "a", "b", "c"]  # forgotten after a second, so its last row, repeated a day later, counts anew
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_live_quantiles_are_near_exact_ones(spark):
    rows = spark.range(20_000).select(F.timestamp_seconds(1_700_000_000 + F.col("id") % 200_000 * 10).alias("ts"), F.when(F.col("id") % 9 > 0, F.pmod(F.xxhash64("id"), F.lit(100_003)).cast("double")).alias("v"), F.lit("r").alias("run"))
    sketches = jobs.complete_result(spark, jobs.live_sketches(jobs.as_stream(spark, rows, 3), "ts", ["run"], "v"))
    pooled = jobs.pooled_quantiles(sketches, ["run"], {"p50": 0.5, "p95": 0.95}).first()
    held = np.array([r["v"] for r in rows.where("v is not null").collect()])
    assert pooled["n"] == len(held)
    for name, share in (("p50", 0.5), ("p95", 0.95)):
        assert abs((held <= pooled[name]).mean() - share) < 0.016


def test_metrics_of_a_run_are_replaced(spark):
    path = new_folder(spark, "metrics")
    rows = spark.createDataFrame([("01", "b", 2, 0.5), ("01", "a", 1, 0.25), ("r2", "a", 1, 1.0)], "run_id string, metric string, section_ord int, mean double")
    traces.write_metrics(rows, path)
    traces.write_metrics(rows.where("run_id = '01' and metric = 'a'").withColumn("mean", F.lit(0.75)), path)
    assert sorted(map(tuple, traces.read_metrics(spark, path).select("run_id", "metric", "mean").collect())) == [("01", "a", 0.75), ("r2", "a", 1.0)]
    assert traces.read_metrics(spark, path, ["r2"]).count() == 1


def test_hedges_are_counted_as_by_all_patterns():
    """Patterns that are passed over for want of their words would have found nothing; letters that only folding makes i, s or k too."""
    patterns = [re.compile(p, re.IGNORECASE) for p in rules.RULES["hedging_token"]]
    words = "may MAY might could possibly it depends varies varie from person to person by individual consider you want to it's hard difficult to say I'm not sure certain be careful cautious proceed with caution take care everyone is different individual results your mileage worth Often uſually lıkely \u0130t depends per\u017fon ta\u212ae care ta\u212ae none other".split(" ")
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 12)) for _ in range(4000)] + ["", "varie by individual", "it depends", "I'm not sure it may be worth it", "it depend\u017f", "ta\u212ae care", "Generally it\u2019s hard to say; your mileage varies by individual"]
    for t in texts:
        assert rules.hedges(t, patterns) == rules.longest_apart(t, patterns), t
    assert rules.hedges("it depend\u017f", patterns) == 1 and rules.hedges("plain words " * 1000, [None] * 7) == 0


def test_all_checks_run_each_pattern_once(spark):
    """One pass over documents, and each pattern of a check in one place of the plan."""
    from evalgrove.plans import catalog

    plan = catalog.QUERIES["all_checks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 1 and plan.count("kcal|cal|calories") == 1 and plan.count("must decline") == 1
