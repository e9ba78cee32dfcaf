"""Report files on disk: reading, hashing, sinks, and the staging stream."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from kerbline.sources import files, sinks, staging, validation
from kerbline.streaming import jobs


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


IPS = "Date,Pole,Terminal,Space Name,Transaction Type,Card #,Total,Coin\n1/2/2024,007.0,0012,S1,Remote/PBC,\xe9 ,2.00,0\n1/2/2024,8,13,S2,Coins,,0.00,0\n,,,,,,2.00,0\n"


def test_latin_1_report(spark, tmp_path):
    path = write(tmp_path, "Transaction Summary 20240103.csv", IPS, "latin-1")
    row, = staging.stage_ips(files.read_report(spark, path, encoding="ISO-8859-1"), 3).collect()
    assert (row.pole, row.terminal, row.card_number, str(row.total), str(row.convenience_fee), row.source_file_id) == ("007", "0012", "\xe9", "2.00", "0.45", 3)


def test_skipped_rows_and_quotes(spark, tmp_path):
    text = 'Report of the day\nGenerated,now\nMID,Void Ind,Settled Date,Settled Amount,Terminal ID\n0080,N,2024-01-02,"$1,234.50",0007\n0081,N,2024-01-02,1.00,0008\n0080,Y,2024-01-02,1.00,0009\n'
    raw = files.read_report(spark, write(tmp_path, "sales.csv", text), skip_rows=2)
    assert raw.columns == ["MID", "Void Ind", "Settled Date", "Settled Amount", "Terminal ID"]
    row, = staging.stage_pi_sales(raw, 4, "0080").collect()
    assert (row.mid, row.terminal_id, str(row.settled_amount)) == ("0080", "0007", "1234.50")


def test_hash_and_dedup(spark, tmp_path):
    for name, text in (("a.csv", "x"), ("b.csv", "x"), ("c.csv", "y"), ("d e.csv", "z")):
        write(tmp_path, name, text)
    found = files.read_files(spark, str(tmp_path))
    registry = spark.createDataFrame([(hashlib.sha256(b"y").hexdigest(),)], "file_hash string")
    assert sorted(r.file_name for r in files.file_dedup(found, registry).collect()) == ["a.csv", "d e.csv"]


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(3)
    sinks.sink(df, path, "fail")
    sinks.sink(df, path, "append")
    assert spark.read.parquet(path).count() == 6
    sinks.sink(df, path, "replace")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.sink(df, path, "fail")
    sinks.sink_by_range(df, str(tmp_path / "sorted"), ["id"])
    assert spark.read.parquet(str(tmp_path / "sorted")).count() == 3


def test_invalid_sales_file(spark):
    df = spark.createDataFrame([("a", "USD"), (None, "US")], "card_number string, settled_currency string")
    with pytest.raises(ValueError, match="business_name: missing column"):
        validation.require_valid(df)
    assert validation.validate_pi(df.limit(1), ("card_number", "settled_currency"), ("settled_currency",)).count() == 0


def test_stage_stream_reads_each_file_once(spark, tmp_path):
    inbox, out = tmp_path / "inbox", str(tmp_path / "staged")
    inbox.mkdir()
    columns = IPS.split("\n")[0].split(",")

    def run():
        jobs.stage_stream(spark, str(inbox), columns, lambda b: staging.stage_ips(b, F.col("source_file")), out, name=f"ips-{tmp_path.name}").awaitTermination()
        return sorted(r.source_file_id for r in spark.read.parquet(out).collect())

    write(inbox, "one.csv", IPS)
    assert run() == ["one.csv"]
    other = IPS.replace("2.00", "3.00")
    write(inbox, "two.csv", other)
    assert run() == ["one.csv", "two.csv"]
    assert run() == ["one.csv", "two.csv"]

    # The same bytes under other names: in one batch, in a later one, and with a name that paths escape.
    write(inbox, "a copy.csv", IPS)
    write(inbox, "three.csv", other.replace("S1", "S2"))
    write(inbox, "three again+.csv", other.replace("S1", "S2"))
    assert run() == ["one.csv", "three again+.csv", "two.csv"]
    assert run() == ["one.csv", "three again+.csv", "two.csv"]
    log = {r.file_name: (r.status, r.first_name, r.records_processed) for r in jobs.staged_files(spark, out).collect()}
    assert log == {"one.csv": ("complete", None, 3), "two.csv": ("complete", None, 3), "a copy.csv": ("duplicate", "one.csv", 3),
                   "three again+.csv": ("complete", None, 3), "three.csv": ("duplicate", "three again+.csv", 3)}


def test_late_last_and_restarted_events_are_counted(spark, tmp_path):
    import datetime as dt

    at = lambda h, m: dt.datetime(2024, 1, 1, h, m, 0)
    schema = "garage_id int, customer_type string, ts timestamp_ntz, step int"
    source, out = str(tmp_path / "events"), str(tmp_path / "changes")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.occupancy_stream(spark.readStream.schema(schema).parquet(source), out, name=f"late-{tmp_path.name}").awaitTermination()
        got = jobs.occupancy_from_stream(spark.read.parquet(out), "2024-01-01 10:00:00", "2024-01-01 10:04:00")
        return [r.total for r in sorted(got.collect(), key=lambda r: r.date)]

    assert run([(1, "transient", at(10, 3), 1)]) == [0, 0, 0, 1]  # the last minute is not withheld
    assert run([(1, "transient", at(13, 0), 1)]) == [0, 0, 0, 1]  # a restart adds a batch
    assert run([(1, "permit", at(10, 1), 1)]) == [0, 1, 1, 2]  # hours late


def test_streams_need_a_lasting_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")

    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        jobs.stream_folder(Bare)
    assert jobs.stream_folder(spark) == f"{named}/streams"


def test_preamble_is_dropped_by_place(spark, tmp_path):
    text = 'Report\nTotals by day\n\n"Name, full",b\nTotals by day,\nx,1\nReport,2\n\n'
    got = files.read_report(spark, write(tmp_path, "p.csv", text), skip_rows=3)
    assert got.columns == ["Name, full", "b"]
    assert [tuple(r) for r in got.collect()] == [("Totals by day", None), ("x", "1"), ("Report", "2")]


def test_line_breaks_in_names_and_fields(spark, tmp_path):
    text = 'Report\n"Name\nfull",b\n"x\ny",1\nReport,2\n'
    got = files.read_report(spark, write(tmp_path, "m.csv", text), skip_rows=1, multi_line=True)
    assert got.columns == ["Name\nfull", "b"] and sorted(map(tuple, got.collect())) == [("Report", "2"), ("x\ny", "1")]
    plain = files.read_report(spark, write(tmp_path, "n.csv", '"Name\nfull",b\n"x\ny","say ""hi"""\n'), multi_line=True)
    assert [tuple(r) for r in plain.collect()] == [("x\ny", 'say "hi"')]


def test_a_preamble_is_counted_by_lines_not_records(spark, tmp_path):
    text = 'Report\n\na,b\n1,a\n2,b\n3,c\n'
    got = files.read_report(spark, write(tmp_path, "q.csv", text), skip_rows=2, multi_line=True)
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "b"), ("3", "c")]
    lone = 'Report of 5" pipes\nby "day\na,"b\nc"\n1,"x\n\ny"\n\n2,"say ""hi"", she\nsaid"\n'
    got = files.read_report(spark, write(tmp_path, "r.csv", lone), skip_rows=2, multi_line=True)
    assert got.columns == ["a", "b\nc"] and sorted(map(tuple, got.collect())) == [("1", "x\n\ny"), ("2", 'say "hi", she\nsaid')]


def test_a_multi_line_report_is_split_anywhere(spark, tmp_path):
    rows = [(str(i), "\n".join(f'part {k} of "{i}"' for k in range(i % 4 + 1))) for i in range(300)]
    text = "Title, \"x\n" + "id,text\n" + "".join('{},"{}"\n'.format(i, t.replace('"', '""')) for i, t in rows)
    path = write(tmp_path, "s.csv", text)
    size, cost = (spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = files.read_report(spark, path, skip_rows=1, multi_line=True)
        assert sorted(map(tuple, got.collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_occupancy_stream(spark, tmp_path):
    import datetime as dt

    at = lambda h, m, s: dt.datetime(2024, 1, 1, h, m, s)
    events = [(1, "transient", at(10, 0, 30), 1), (1, "permit", at(10, 1, 0), 1), (1, "transient", at(10, 2, 1), -1), (2, "employee", at(10, 3, 0), 1),
              (1, "permit", at(12, 0, 0), -1)]
    schema = "garage_id int, customer_type string, ts timestamp_ntz, step int"
    source, out = str(tmp_path / "events"), str(tmp_path / "changes")
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    jobs.occupancy_stream(stream, out, name=f"occ-{tmp_path.name}").awaitTermination()
    got = jobs.occupancy_from_stream(spark.read.parquet(out), "2024-01-01 10:00:00", "2024-01-01 10:05:00")
    totals = {(r.garage_id, r.date.minute): r.total for r in got.collect()}
    assert [totals[1, m] for m in range(5)] == [1, 2, 2, 1, 1] and [totals[2, m] for m in range(5)] == [0, 0, 0, 1, 1]


def test_compaction_keeps_all_counts(spark, tmp_path, monkeypatch):
    import datetime as dt

    from kerbline.sources.versions import VersionedTable

    at = lambda d, h, m: dt.datetime(2024, 1, d, h, m)
    schema = "garage_id int, customer_type string, ts timestamp_ntz, step int"
    source, out = str(tmp_path / "events"), str(tmp_path / "changes")

    def stream(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.occupancy_stream(spark.readStream.schema(schema).parquet(source), out, name=f"compact-{tmp_path.name}").awaitTermination()

    def counts():
        got = jobs.occupancy_from_stream(jobs.stream_changes(spark, out), "2024-01-01 10:00:00", "2024-01-03 10:00:00")
        return {(r.garage_id, r.date): r.total for r in got.collect()}

    stream([(1, "transient", at(1, 10, 5), 1), (2, "permit", at(1, 11, 0), 1)])
    stream([(1, "transient", at(2, 10, 5), -1)])
    before = counts()
    assert before[1, at(1, 10, 5)] == 1 and before[1, at(2, 10, 6)] == 0
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_point", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            jobs.compact_changes(spark, out, 1)
    assert counts() == before
    table = jobs.compact_changes(spark, out, 1)
    assert counts() == before and table.read().count() == 3 and table.state()["note"] == {"through": 1}
    first_day = {r.day: r._version for r in table.manifest().collect()}
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_point", lambda self, state: (_ for _ in ()).throw(RuntimeError("lost")))
        stream([(1, "permit", at(2, 12, 0), 1)])
        with pytest.raises(RuntimeError, match="lost"):
            jobs.compact_changes(spark, out, 2)
    after = counts()
    assert after[1, at(2, 12, 0)] == 1 and after[1, at(2, 11, 59)] == 0
    jobs.compact_changes(spark, out, 2)
    assert counts() == after
    second = {r.day: r._version for r in table.manifest().collect()}
    assert len(second) == 2 and sum(second[d] == first_day[d] for d in second) == 1
    assert jobs.compact_changes(spark, out, 2).state()["note"] == {"through": 2}
