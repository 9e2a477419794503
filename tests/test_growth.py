"""Work that must not grow faster than the input: expressions evaluated once a
row, tables written before they are read again, as many files as splits."""

import base64
import glob
import os

import pytest
from pyspark.sql import functions as F

from mailsift.operators.keyed import Versions
from mailsift.plans.registry import QUERIES, load_all
from mailsift.sources import messages as SM

load_all()
NAMES = ["p02_header_lookup", "p03_base64url_decode", "p04_mime_parts", "p06_addresses", "p11_normalize"]


def docs(spark, folder, files=1):
    rows = spark.range(0, 120, 1, files).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Hello é + ? "), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    rows.write.parquet(os.path.join(folder, "documents.parquet"))
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_each_message_is_built_and_parsed_once(spark, tmp_path, name):
    plan = QUERIES[name](spark, docs(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert plan.count("sizeEstimate") == 1


def test_base64url_fast_way_equals_the_cleaned_way(spark):
    b = lambda t: base64.urlsafe_b64encode(t.encode()).decode()
    cases = {b("abc"): "abc", b("ab").rstrip("="): "ab", b("ab"): "ab", b("a?>ÿ").rstrip("="): "a?>ÿ",
             "YW!!\nJj": "abc", "YW Jj": "abc", "YW+Jj": "abc", "YW/Jj": "abc", "YW=Jj": "abc", "YR": "a", "": "", "Y": "",
             "_-": "�", None: ""}
    rows = spark.createDataFrame(list(cases.items()), "d string, want string")
    got = rows.select("d", "want", SM.b64url_text("d").alias("got")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []


def test_store_reads_a_written_table(spark, tmp_path):
    plan = QUERIES["s03_message_store"](spark, docs(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" not in plan


@pytest.mark.parametrize("name", ["line", "queue"])
def test_stream_inputs_have_a_file_a_split(spark, tmp_path, monkeypatch, name):
    from mailsift.plans import q_stream as Q
    sf = docs(spark, str(tmp_path / "sf"), files=6)
    monkeypatch.setattr(Q, "_scratch", lambda spark, n: str(tmp_path / "scratch"))
    monkeypatch.setattr(Q, "spread", lambda df: df.repartition(5))
    if name == "queue":
        Q._write_inputs(spark, sf, str(tmp_path / "scratch"))
    else:
        monkeypatch.setattr(Q.W, "run_available", lambda *a: None)
        monkeypatch.setattr(Q, "answers", lambda *a: None)
        Q._line_run(spark, sf, 1)
    assert len(glob.glob(str(tmp_path / "scratch" / "in" / "part-*"))) == 5


def test_bodies_of_a_stream_stay_in_place_until_their_buckets(spark, tmp_path, monkeypatch):
    """Positions, first copies and stored keys are joined without a shuffle of the
    messages; only the merge into the buckets has one."""
    from mailsift.plans import job
    from mailsift.streaming import jobs as W
    rows = [(k, f'{{"id": "m{k % 90}", "payload": {{"mimeType": "text/plain", "body": {{"data": "aGk"}}}}}}') for k in range(100)]
    batch = spark.createDataFrame(rows, "position long, value string")
    answers = spark.createDataFrame([], "message_id string, raw_text string")
    seen, written = [], []
    known = lambda msgs: job.unseen(msgs, str(tmp_path / "t"), 2, W.ROW)
    keep = lambda msgs, *_: seen.append(msgs)
    write = Versions.write
    monkeypatch.setattr(Versions, "write", lambda self, rows, *a, **b: (written.append(rows), write(self, rows, *a, **b))[1])
    W.outcomes(batch.filter("position < 60"), answers, tables=lambda *a: job.write_tables(*a, str(tmp_path / "t"), 1))
    plan = written[0].repartition("bucket")._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in shuffles(plan) if "body" in x]) == 1
    W.outcomes(batch, answers, tables=keep, known=known)
    assert sorted(int(r.message_id[1:]) for r in seen[0].select("message_id").collect()) == list(range(60, 90))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert not shuffles(plan), plan


def shuffles(plan):
    """Each shuffle with the columns below it."""
    lines = plan.splitlines()
    return [" ".join(lines[i:i + 3]) for i, x in enumerate(lines) if "Exchange " in x and "Broadcast" not in x]


def test_positions_need_no_shuffle_of_the_rows(spark, tmp_path):
    spark.range(50).selectExpr("cast(id as string) as value").write.text(str(tmp_path / "in"))
    placed = spark.read.parquet(stored_at(SM.placed_lines(SM.source_lines(spark.read.text(str(tmp_path / "in")))), tmp_path))
    plan = SM.with_positions(placed)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in shuffles(plan) if "value#" in x], plan


def stored_at(df, folder):
    df.write.parquet(str(folder / "placed"))
    return str(folder / "placed")


def test_an_epoch_leaves_no_intermediate_tables(spark, tmp_path, monkeypatch):
    from mailsift import config
    from mailsift.streaming import jobs as W
    monkeypatch.setattr(config, "shared_dir", lambda spark, name: str(tmp_path / "shared" / name))
    rows = [(k, f'{{"id": "m{k}", "payload": {{"mimeType": "text/plain", "body": {{"data": "aGk"}}}}}}') for k in range(20)]
    batch = spark.createDataFrame(rows, "position long, value string")
    answers = spark.createDataFrame([], "message_id string, raw_text string")
    W.triage_sink(str(tmp_path / "out"), answers)(batch, 0)
    assert os.listdir(tmp_path / "shared") == []
    assert W.current_outcomes(spark, str(tmp_path / "out")).count() == 20
    assert spark.conf.get(config._CLEANUP) == "false"


def test_tables_merge_in_passes(spark, tmp_path, monkeypatch):
    """Stored messages stay, new ones come, some are in both."""
    from mailsift.plans import job
    from mailsift.streaming import jobs as W
    message = lambda k, s: (f'{{"id": "m{k}", "payload": {{"mimeType": "text/plain", "headers": '  # noqa: E731
                            f'[{{"name": "Subject", "value": "{s}"}}], "body": {{"data": "aGk"}}}}}}')
    answers = spark.createDataFrame([], "message_id string, raw_text string")
    monkeypatch.setattr(job, "PASS_ROWS", 10)
    written, write = [], Versions.write
    monkeypatch.setattr(Versions, "write", lambda self, rows, name, *a, **b: (written.append(name), write(self, rows, name, *a, **b))[1])
    for v, ks in ((1, range(40)), (2, range(30, 60))):
        batch = spark.createDataFrame([(k, message(k, f"v{v}")) for k in ks], "position long, value string")
        W.outcomes(batch, answers, tables=lambda *a, v=v: job.write_tables(*a, str(tmp_path), v, buckets=16))
    assert written.count("messages") == 8
    got = {r.provider_message_id: r.subject for r in job.read_current(spark, str(tmp_path), "messages").collect()}
    assert got == {f"m{k}": "v1" if k < 40 else "v2" for k in range(60)}


@pytest.mark.parametrize("name", ["line", "queue"])
def test_exports_are_compressed(spark, tmp_path, monkeypatch, name):
    from mailsift.plans import q_stream as Q
    monkeypatch.setattr(Q, "_scratch", lambda spark, n: str(tmp_path / "scratch"))
    monkeypatch.setattr(Q.W, "run_available", lambda *a: None)
    monkeypatch.setattr(Q.W, "current_outcomes", lambda *a: None)
    monkeypatch.setattr(Q, "answers", lambda *a: None)
    (Q._line_run if name == "line" else Q._triage_run)(spark, docs(spark, str(tmp_path / "sf")), 2)
    files = glob.glob(str(tmp_path / "scratch" / "in" / "part-*"))
    assert files and all(f.endswith(".gz") for f in files)
    assert spark.read.text(str(tmp_path / "scratch" / "in")).count() == 240


def test_dedupe_deals_the_text_only(spark, tmp_path):
    """The parsed message does not travel with the text."""
    from mailsift.streaming import jobs as W
    spark.createDataFrame([(1, "{}")], "position long, value string").write.json(str(tmp_path / "in"))
    stream = W.raw_dedupe_stream(W.message_stream(spark, str(tmp_path / "in")))
    assert stream.columns == ["position", "value", "raw", "corrupt"]
    plan = stream._jdf.queryExecution().analyzed()
    while plan.nodeName() != "DeduplicateWithinWatermark":
        plan = plan.children().head()
    assert "raw" not in plan.output().toString()
