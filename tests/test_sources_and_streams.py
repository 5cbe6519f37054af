import json
import random
import time

import pytest
from pyspark.sql import functions as F

from amendry import schemas
from amendry.functions import hooks
from amendry.operators import scoring, sft
from amendry.sources import files
from amendry.streaming import ingest


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id":"1","draft":"あ"}\n\n{"id":"2"}\n{"id":"3"}\n')
    assert sorted(r.id for r in files.read_jsonl(spark, str(path), schemas.REVISION_PAIRS).collect() if r.id) == ["1", "2", "3"]
    assert [r.id for r in files.read_jsonl(spark, str(path), schemas.REVISION_PAIRS, 2).collect()] == ["1", "2"]
    df = spark.createDataFrame([("1", "train"), ("2", "test")], "id string, split string")
    files.write_split(df, str(tmp_path / "split"))
    assert spark.read.schema("id string").json(str(tmp_path / "split/split=train")).first().id == "1"
    files.write_report(df, str(tmp_path / "report"))
    files.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.schema("id string").json(str(tmp_path / "out")).count() == 2


def test_hard_eval_manifest_reports_and_folders(spark, tmp_path):
    item = {"id": "h", "base_text": "b", "candidates": [{"id": "a", "text": "t"}], "human": {"best_id": "a", "rank": ["a"]}, "status": "labeled", "seed_meta": {"k": "v"}}
    (tmp_path / "h.jsonl").write_text("\n" + json.dumps(item) + "\n")
    row = files.read_hard_eval(spark, str(tmp_path / "h.jsonl")).first()
    assert (row.line_no, row.id, row.candidates[0].text, row.seed_meta) == (2, "h", "t", {"k": "v"})
    (tmp_path / "m.json").write_text(json.dumps([{"project_id": "p", "branch_pairs": [{"base": "main", "edit": "edit/a"}], "paths": []}]))
    assert files.read_manifest(spark, str(tmp_path / "m.json")).first().branch_pairs[0].edit == "edit/a"
    (tmp_path / "r.json").write_text(json.dumps({"embedding_model": "e", "micro_accuracy": 0.5, "folds": [{"project_id": "p", "accuracy": 1.0}]}, indent=1))
    report = files.collect_reports(spark, str(tmp_path / "r.json")).first()
    assert report.folds[0].accuracy == 1.0 and report.source == "r.json"
    folder = tmp_path / "cands"
    folder.mkdir()
    for name in ("b.txt", "a.txt", ".hidden"):
        (folder / name).write_text(name)
    assert sorted((r.cand_index, r.text) for r in files.read_candidates_dir(spark, str(folder)).collect()) == [(0, "a.txt"), (1, "b.txt")]
    assert {r.path for r in files.read_revisions(spark, str(folder), "p", "x").collect()} == {"a.txt", "b.txt"}


def test_activations_of_unequal_length_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([("a", "p", 0, [1.0], [1.0, 2.0])], schemas.ACTIVATIONS)
    df.write.parquet(str(tmp_path / "act"))
    with pytest.raises(Exception, match="unequal vectors"):
        files.read_activations(spark, str(tmp_path / "act")).collect()


EX = "project_id string, source_text string, edited_text string, source_reference string, created_at timestamp"


def feed(spark, path, own):
    df = spark.createDataFrame(own, EX.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
    df.coalesce(1).write.mode("append").parquet(str(path))


def ingested(spark, tmp_path, **options):
    stream = spark.readStream.schema(EX).parquet(str(tmp_path / "in"))
    q = ingest.stream_append_new(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options)
    q.processAllAvailable()
    q.stop()
    return q


def test_stream_appends_each_key_once_for_all_time(spark, tmp_path):
    rows = [("p", "s", "e", "r", "2026-01-01 00:00:00"), ("p", "s", "e", "r", "2026-01-01 00:05:00"), ("p", "s2", "e", "r", "2026-01-01 00:10:00"), ("p", None, "e", "r", "2026-01-01 00:10:00"), ("p", "", "e", "r", "2026-01-01 00:10:00")]
    known = spark.createDataFrame([("p", "old", "e", "r")], "project_id string, source_text string, edited_text string, source_reference string")
    late = ingest.LateRows()
    spark.streams.addListener(late)
    try:
        feed(spark, tmp_path / "in", rows)
        ingested(spark, tmp_path, existing=known)
        feed(spark, tmp_path / "in", [("p", "s3", "e", "r", "2026-01-09 00:00:00"), ("p", "old", "e", "r", "2026-01-09 00:00:00")])
        ingested(spark, tmp_path, existing=known)
        feed(spark, tmp_path / "in", [("p", "s2", "e", "r", "2026-01-30 00:00:00"), ("p", "late", "e", "r", "2026-01-02 00:00:00"), ("p", "late2", "e", "r", "2026-01-03 00:00:00"), ("p", "s4", "e", "r", "2026-01-30 00:00:00")])
        q = ingested(spark, tmp_path, existing=known)  # s2 comes again long after the watermark has passed it
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if late.counts:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(str(r.source_text) for r in out.collect()) == ["", "None", "s", "s2", "s3", "s4"] and "_key" not in out.columns
    assert [(r["query"], r.late_rows) for r in late.table(spark).collect()] == [(q.id, 2)]


def test_bytes_read_by_a_batch_do_not_grow_with_the_target(spark, tmp_path):
    """A batch reads its own file; what was appended before it is not read again."""
    sizes = []
    for k in range(4):
        feed(spark, tmp_path / "in", [("p", f"{k} {i} " + "text " * 200, "e", "r", "2026-01-01 00:00:00") for i in range(300)])
        q = ingested(spark, tmp_path)
        sizes.append([sum(s["numInputRows"] for s in p["sources"]) for p in q.recentProgress if p["numInputRows"]])
        plan = q._jsq.streamingQuery().lastExecution().executedPlan().toString() if hasattr(q._jsq, "streamingQuery") else ""
        assert str(tmp_path / "out") not in plan
    assert sizes == [[300]] * 4 and spark.read.parquet(str(tmp_path / "out")).count() == 1200


HUNKS = "file string, line_no int, source_text string, edited_text string, src array<double>, a array<double>, len_src double, len_a double"


def test_stream_check_equals_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"f{i % 3}", i, "x y" if i % 5 else "", f"y {i}", [rng.random(), rng.random()], [rng.random(), rng.random()], 1.0, float(i % 7)) for i in range(40)]
    w = scoring.literal_weights([0.3 * ((i * 7) % 5 - 2) for i in range(27)])
    for part in (rows[:15], rows[15:16], rows[16:]):
        spark.createDataFrame(part, HUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(HUNKS).parquet(str(tmp_path / "in"))
        for name, df, mode in (("checked", ingest.stream_check(stream, w), "append"), ("flagged", ingest.stream_check(stream, w, flagged=True), "append")):
            q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode(mode).start()
            q.processAllAvailable()
            q.stop()
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(str(tmp_path / "totals"))
        q = ingest.stream_summary(stream, w).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "totals-state")).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
    whole = spark.createDataFrame(rows, HUNKS)
    columns = ["file", "line_no", "index", "verdict", "source_preview", "edited_preview"]
    pick = lambda df: sorted((*(r[c] for c in columns), round(r.margin, 9)) for r in df.collect())
    own = scoring.check(whole, w)
    assert pick(spark.read.parquet(str(tmp_path / "checked"))) == pick(own) and own.count() == 32
    assert pick(spark.read.parquet(str(tmp_path / "flagged"))) == pick(scoring.only_flagged(own))
    stats = {r.file: r for r in scoring.hunk_stats(own, total=False).collect()}
    totals = spark.read.parquet(str(tmp_path / "totals")).collect()
    assert {r.file for r in totals} == set(stats)
    for r in totals:
        assert all(r[c] == pytest.approx(stats[r.file][c]) for c in stats[r.file].asDict() if c != "file")
        summary = scoring.verdict_summary(own.where(F.col("file") == r.file)).first()
        assert all(r[v] == summary[v] for v in scoring.VERDICTS)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """A file of many splits, and small ones beside it that share a task."""
    big = [f"{i} " + "é" * (i % 50) for i in range(5000)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/big.txt").write_text("\n".join(big) + "\n")
    for k in range(5):
        (tmp_path / f"d/s{k}.txt").write_text("\n".join(f"{k}-{i}" for i in range(k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_numbered_lines(spark, str(tmp_path / "d"))
        rows = df.collect()
        parts = df.where("file LIKE '%big.txt'").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted((r for r in rows if r.file.endswith("big.txt")), key=lambda r: r.line_no)] == big
    assert sorted(r.line_no for r in rows if r.file.endswith("big.txt")) == list(range(1, 5001)) and parts >= 1
    assert sorted((r.value, r.line_no) for r in rows if not r.file.endswith("big.txt")) == sorted((f"{k}-{i}", i + 1) for k in range(5) for i in range(k))


def test_places_are_counted_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("string").alias("name"))
    found = {r.name: r.n for r in files.numbered(df, "name", "n", start=1).collect()}
    assert found == {name: i + 1 for i, name in enumerate(sorted(map(str, range(1000))))}
    assert files.numbered(df.limit(0), "name", "n").count() == 0


def test_hooks(spark):
    df = spark.createDataFrame([("abc",), ("abc",), ("日本語だ",), ("",)], "text string")
    found = {r.text: r.vec for r in hooks.encode_texts(df, dim=16).collect()}
    assert len(found) == 3 and sum(x * x for x in found["abc"]) == pytest.approx(1, abs=1e-6) and sum(found[""]) == 0
    gen = hooks.generate(df.withColumn("prompt", F.col("text")), lambda texts: [t.upper() for t in texts]).collect()
    assert gen[0].generated == "ABC"
    scored = hooks.score(df.select(F.col("text").alias("source_text"), F.lit("x").alias("candidate")), lambda s, c: [float(len(x)) for x in s]).collect()
    assert [r.score for r in scored] == [3.0, 3.0, 4.0, 0.0]
    items = spark.createDataFrame([(1, "bb", [("a", "x" * 5)]), (2, "bb", [("a", "x" * 50)])], "id int, base_text string, candidates array<struct<id:string,text:string>>")
    assert [r.id for r in hooks.fits_tokens(items, 10).collect()] == [1] and [r.id for r in hooks.fits_tokens(items, 10, lambda b, t: len(t)).collect()] == [1]


def test_default_encoder_equals_its_plain_version(spark):
    texts = ["abc", "ab", "", "aaaa aaaa", "日本語だ。漢字とかな", "emoji 🎉🎉🎉 é", "line\nline\tx" * 30, None]
    df = spark.createDataFrame([(t,) for t in texts + texts[:2]], "text string")
    for options in ({}, {"prefix": "q: "}, {"dim": 40}, {"normalize": False}):
        found = {r.text: r.vec for r in hooks.encode_texts(df, **options).collect()}
        plain = {r.text: r.vec for r in hooks.encode_texts(df, hooks.hashed_ngrams, **options).collect()}
        assert set(found) == set(texts) == set(plain)
        assert all(found[t] == pytest.approx(plain[t], abs=1e-6) and len(found[t]) == options.get("dim", 256) for t in texts)


def test_supervised_rows(spark):
    pairs = spark.createDataFrame([("1", "p", "a\n\nb", "c", 1), ("2", "p", "d", "e", 2), ("3", "q", "f", "gg", 3), ("4", "p", "h", "i", 4), ("5", "r", "j", "k", 5), ("6", "r", "l", "m", 6)], "id string, project_id string, draft string, revised string, line_no int")
    chat = sft.chat_rows(pairs, "Do.")
    assert chat.select(sft.draft_of(F.get("messages", F.lit(0))["content"]).alias("d")).first().d == "a\n\nb"
    assert sft.sft_rows(chat, 2).count() == 2 and sft.sft_rows(chat).columns == ["messages"]
    assert [r.project_id for r in sft.round_robin(pairs, 4).collect()] == ["p", "q", "r", "p"]
    held = {r.id: r.split for r in sft.sft_holdout(pairs, spark.createDataFrame([("q",)], "project_id string")).collect()}
    assert held == {"1": "train", "2": "train", "3": "holdout", "4": "train", "5": "train", "6": "train"}
    assert sft.pair_stats(pairs).where("project_id IS NULL").first().n == 6
    got = pairs.select(sft.char_similarity("draft", "revised").alias("s"), sft.edit_similarity("draft", "revised").alias("e")).collect()
    assert got[0].s == 0.0 and 0 <= got[0].e <= 1
