"""Sources, sinks, batched scoring and streaming."""

from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from jetloom import DEFAULT_CUTS, LOOSE_CUTS
from jetloom import sources as IO
from jetloom.operators.selection import pick_pairs
from jetloom.plans import flows
from jetloom.schema import PARALLEL_EVENT
from jetloom.session import checkpoint_root, stage
from jetloom.streaming import ingest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files of 4, 5 and 6 parallel-array events with two good jets each."""
    path = tmp_path_factory.mktemp("events")
    start = 0
    for k, n in enumerate((4, 5, 6)):
        rows = [
            (start + i, [90.0 + i, 80.0, 10.0], [0.0, 1.0, 2.0], [0.0, 3.0, 1.0], [1.0] * 3, [1.0] * 3)
            for i in range(n)
        ]
        spark.createDataFrame(rows, PARALLEL_EVENT).coalesce(1).write.parquet(str(path / f"part{k}"))
        start += n
    return path


def files(folder):
    return sorted(str(p) for p in folder.glob("part*/*.parquet"))


def loose(events, keep=()):
    return pick_pairs(events, LOOSE_CUTS, unit="GeV", keep=keep)


def ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


def test_reads(spark, folder):
    events = IO.read_events(spark, files(folder), "parallel", lineage=True)
    assert ids(events) == list(range(15))
    assert events.select("file_path").distinct().count() == 3
    info = IO.dataset_info(spark, files(folder)).first()
    assert (info["n_files"], info["total_events"], info["avg_events_per_file"]) == (3, 15, 5.0)
    size = sum(__import__("os").path.getsize(f) for f in files(folder))
    assert info["total_size_gb"] == pytest.approx(size / 1024**3)
    hollow = str(folder / "hollow")
    spark.createDataFrame([], PARALLEL_EVENT).coalesce(1).write.parquet(hollow)
    with_empty = IO.dataset_info(spark, [*files(folder), hollow]).first()
    assert (with_empty["n_files"], with_empty["total_events"], with_empty["avg_events_per_file"]) == (4, 15, 3.75)
    narrow = IO.read_events(spark, files(folder), "parallel", columns=["pt"])
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert narrow.columns == ["event_id", "pt"] and "eta" not in plan
    assert ids(IO.cap_events(events, 6)) == list(range(6))
    assert IO.cap_events(events, None) is events
    with pytest.raises(ValueError):
        IO.read_events(spark, files(folder), "other")


def test_bad_inputs(spark, folder, tmp_path):
    junk = tmp_path / "junk.parquet"
    junk.write_text("this is not a table")
    with pytest.raises(Exception):
        IO.read_events(spark, [*files(folder), str(junk)], "parallel").count()
    survivors = IO.read_events(spark, [*files(folder), str(junk)], "parallel", skip_bad_files=True)
    assert ids(survivors) == list(range(15))
    with pytest.raises(AnalysisException):
        IO.read_table(spark, str(tmp_path / "absent"))
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(AnalysisException):
        IO.read_table(spark, str(empty))


def test_sinks_round_trip(spark, folder, tmp_path):
    out = loose(IO.read_events(spark, files(folder), "parallel"))
    want = sorted(map(tuple, out.collect()))
    IO.write_parquet(out, str(tmp_path / "p"))
    assert sorted(map(tuple, IO.read_table(spark, str(tmp_path / "p")).collect())) == want
    assert any(".snappy." in f.name for f in (tmp_path / "p").iterdir())
    IO.write_csv(out, str(tmp_path / "c"))
    back = spark.read.schema(out.schema).option("header", True).csv(str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == want
    IO.write_json_records(out, str(tmp_path / "j"))
    assert sorted(map(tuple, IO.read_json_records(spark, str(tmp_path / "j"), out.schema).collect())) == want
    assert sorted(map(tuple, IO.reload_stage(spark, IO.write_stage(out)).collect())) == want


def test_one_output_per_source(spark, folder, tmp_path):
    events = IO.read_events(spark, files(folder), "parallel", lineage=True)
    IO.per_source_output(loose(events, keep=("file_path",)), str(tmp_path / "o"))
    folders = [p for p in (tmp_path / "o").iterdir() if p.name.startswith("source_file=")]
    sizes = sorted(spark.read.parquet(str(p)).count() for p in folders)
    assert sizes == [4, 5, 6]


def test_equal_names_in_two_folders_stay_apart(spark, folder, tmp_path):
    wide = IO.read_events(spark, files(folder), "parallel")
    for name in ("one", "two"):
        (tmp_path / "in" / name).mkdir(parents=True)
        wide.where(f"event_id % 2 = {name == 'two':d}").toPandas().to_parquet(tmp_path / "in" / name / "same.v1.parquet")
    events = spark.read.parquet(str(tmp_path / "in" / "one"), str(tmp_path / "in" / "two")).select("event_id", "_metadata.file_path")
    for root in (None, str(tmp_path / "in")):
        IO.per_source_output(events, str(tmp_path / "o"), root=root)
        back = spark.read.parquet(str(tmp_path / "o"))
        want = {(i, ("one", "two")[i % 2] + "/same.v1") for i in range(15)}
        assert {(r["event_id"], r["source_file"]) for r in back.collect()} == want


def test_ledger_of_a_scan(spark, folder, tmp_path):
    junk = tmp_path / "junk.parquet"
    junk.write_text("this is not a table")
    whole = tmp_path / "whole.parquet"
    rows = spark.read.parquet(files(folder)[0]).toPandas()
    rows.to_parquet(whole)
    broken = tmp_path / "broken.parquet"
    content = bytearray(whole.read_bytes())
    content[4:200] = bytes(196)  # data pages; the footer still reads
    broken.write_bytes(content)
    paths = [*files(folder), str(junk), str(whole), str(broken)]
    events = IO.read_events(spark, paths, "parallel", lineage=True, skip_bad_files=True, ledger=str(tmp_path / "ledger"))
    ledger = {r["file_path"].rsplit("/", 1)[-1]: r for r in spark.read.parquet(str(tmp_path / "ledger")).collect()}
    # Whole rows: a mere count is answered from the footers and does not meet the fault.
    seen = Counter(r["file_path"].rsplit("/", 1)[-1] for r in events.collect())
    assert {name for name, r in ledger.items() if r["status"] == "empty or unreadable"} == {"junk.parquet", "broken.parquet"}
    assert {name: r["events"] for name, r in ledger.items() if r["status"] == "read"} == seen
    assert ledger["whole.parquet"]["length"] == whole.stat().st_size
    same = [r["checksum"] for name, r in ledger.items() if r["events"] == len(rows)]
    assert ledger["whole.parquet"]["checksum"] in same


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2.0)], ["event_id", "x"])
    b = spark.createDataFrame([(1,), (3,)], ["event_id"])
    out = IO.union_tables([a, b])
    assert out.count() == 3 and out.where("x is null").count() == 2


def test_batches_of_ten(spark, tmp_path):
    paths = []
    for i in range(25):
        row = [(i, [90.0, 80.0], [0.0, 0.0], [0.0, 3.0], [1.0, 1.0], [1.0, 1.0])]
        target = str(tmp_path / f"in{i}")
        spark.createDataFrame(row, PARALLEL_EVENT).coalesce(1).write.parquet(target)
        paths += [str(p) for p in (tmp_path / f"in{i}").glob("*.parquet")]
    listing = tmp_path / "list.txt"
    listing.write_text("\n".join(paths) + "\n\n")
    flows.batch_inference(
        spark, str(listing), str(tmp_path / "out"), lambda e: loose(e, keep=("batch",)), layout="parallel"
    )
    got = spark.read.parquet(str(tmp_path / "out"))
    sizes = {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()}
    assert sizes == {1: 10, 2: 10, 3: 5}
    assert got.where("batch = 2").agg(F.min("event_id"), F.max("event_id")).first() == (10, 19)

    broken = tmp_path / "broken.txt"
    broken.write_text("\n".join([*paths[:10], str(tmp_path / "absent.parquet"), *paths[10:20]]))
    assert {b for _, b in flows.plan_batches(spark, str(broken))} == {1, 3}


def test_batches_lose_no_file(spark, tmp_path, monkeypatch):
    def write(name, first, n):
        rows = [(first + i, [90.0, 80.0], [0.0, 0.0], [0.0, 3.0], [1.0, 1.0], [1.0, 1.0]) for i in range(n)]
        spark.createDataFrame(rows, PARALLEL_EVENT).coalesce(1).write.parquet(str(tmp_path / name))
        return str(next((tmp_path / name).glob("*.parquet")))

    spaced, plain = write("a folder", 0, 2), write("plain", 10, 3)
    junk = tmp_path / "junk.parquet"
    junk.write_text("this is not a table")
    relative = __import__("os").path.relpath(write("near", 20, 4))
    entries = [spaced, plain, relative, str(tmp_path / "a folder"), plain, str(junk), str(tmp_path / "absent"), spaced]
    listing = tmp_path / "list.txt"
    listing.write_text("\n".join(entries))
    report = flows.batch_inference(
        spark, str(listing), str(tmp_path / "out"), lambda e: loose(e, keep=("batch",)), "parallel", batch_size=2
    )
    got = spark.read.parquet(str(tmp_path / "out"))
    # The last batch names a missing file; the spaced file is also read through its folder.
    assert {r["batch"]: r["count"] for r in got.groupBy("batch").count().collect()} == {1: 5, 2: 6, 3: 3}
    status = {r["position"]: (r["events"], r["status"]) for r in report.collect()}
    assert status == {
        0: (2, "read"), 1: (3, "read"), 2: (4, "read"), 3: (2, "read"), 4: (3, "read"),
        5: (0, "empty or unreadable"), 6: (0, "missing"), 7: (0, "skipped with its batch"),
    }
    monkeypatch.setattr(flows, "BROADCAST_FILES", 0)
    flows.batch_inference(
        spark, str(listing), str(tmp_path / "out2"), lambda e: loose(e, keep=("batch",)), "parallel", batch_size=2
    )
    assert ids(spark.read.parquet(str(tmp_path / "out2"))) == ids(got)
    bare = tmp_path / "bare"
    bare.mkdir()
    listing.write_text("\n".join([plain, str(bare)]))
    with pytest.raises(ValueError, match="without files"):
        flows.batch_inference(spark, str(listing), str(tmp_path / "out3"), lambda e: e, "parallel")


def test_stream_equals_batch(spark, folder, tmp_path):
    source = str(folder / "part*")
    want = sorted(map(tuple, loose(IO.read_events(spark, files(folder), "parallel")).collect()))
    stream = ingest.stream_events(spark, source, "parallel")
    ingest.process_to_parquet(stream, loose, str(tmp_path / "s"), str(tmp_path / "sc"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == want
    # A second run finds nothing new.
    ingest.process_to_parquet(
        ingest.stream_events(spark, source, "parallel"), loose, str(tmp_path / "s"), str(tmp_path / "sc")
    )
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(want)
    stream = ingest.stream_events(spark, source, "parallel", files_per_batch=1)
    ingest.process_batches(stream, loose, str(tmp_path / "b"), str(tmp_path / "bc"))
    out = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(map(tuple, out.drop("batch_id").collect())) == want
    assert out.select("batch_id").distinct().count() == 3


def test_stream_skips_unreadable_files(spark, folder, tmp_path):
    source = tmp_path / "in"
    IO.read_table(spark, str(folder / "part0")).write.parquet(str(source))
    (source / "part-junk.parquet").write_text("this is not a table")
    stream = ingest.stream_events(spark, str(source), "parallel", skip_bad_files=True)
    ingest.process_to_parquet(stream, loose, str(tmp_path / "s"), str(tmp_path / "sc"))
    assert ids(spark.read.parquet(str(tmp_path / "s"))) == [0, 1, 2, 3]


def test_user_functions(spark, folder):
    events = IO.read_events(spark, files(folder), "parallel")
    doubled = flows.apply_pandas_function(
        loose(events).select("event_id", "n_jets"), lambda c: c.assign(n_jets=c["n_jets"] * 2), "event_id bigint, n_jets bigint"
    )
    assert {r["n_jets"] for r in doubled.collect()} == {4}
    chained = flows.process_files(spark, files(folder), [loose, lambda d: d.where("event_id < 3")], "parallel")
    assert ids(chained) == [0, 1, 2]


def test_prepared_flow_has_no_shuffle(spark, folder):
    events = IO.read_events(spark, files(folder), "parallel")
    table = flows.prepare_events(events, DEFAULT_CUTS.with_(mjj_min=None), unit="GeV")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert table.count() == 15


def test_staging_uses_the_session_folder(spark):
    staged = stage(spark.range(10))
    assert staged.count() == 10 and "Scan ExistingRDD" in staged._jdf.queryExecution().executedPlan().toString()
    assert checkpoint_root(spark) == checkpoint_root(spark)
