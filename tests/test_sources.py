"""Sheets, names, sources and sinks on hand-written cases."""

import os
from datetime import datetime, timedelta

import pytest
from helpers import START
from pyspark.sql import functions as F

from gridloom import session
from gridloom.functions import text as tx
from gridloom.operators import naming as nm
from gridloom.operators import sheets as sh
from gridloom.session import scratch_path, shared_folder
from gridloom.sources import cells as ce
from gridloom.sources import records as rec
from gridloom.sources import tables as tb
from gridloom.streaming import jobs


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["out"] for r in df.select("i", expr("t").alias("out")).orderBy("i").collect()]


def test_timestamps(spark):
    cases = {
        "01-08-2022 00:15": datetime(2022, 8, 1, 0, 15),
        "02/01/2024 00:15": datetime(2024, 1, 2, 0, 15),
        "2024-01-02 03:00": datetime(2024, 1, 2, 3),
        "2024-01-02T03:00:05": datetime(2024, 1, 2, 3, 0, 5),
        "44927": datetime(2023, 1, 1),
        "44927.5": datetime(2023, 1, 1, 12),
        "x": None,
        "": None,
        "1-8-2022 0:15": datetime(2022, 8, 1, 0, 15),
        "02/01/2024": datetime(2024, 1, 2),
        "2023": datetime(2023, 1, 1),
        "20240102": datetime(2024, 1, 2),
        "01/13/2024 05:06": datetime(2024, 1, 13, 5, 6),
        "2 Jan 2024 05:06": datetime(2024, 1, 2, 5, 6),
        "02/01/2024 03:15 PM": datetime(2024, 1, 2, 15, 15),
        "31-02-2024": None,
        "19999": None,
        "70001": None,
        "Jan 5, 2024 10:15": datetime(2024, 1, 5, 10, 15),
        "Jan 5, 2024 10:15 PM": datetime(2024, 1, 5, 22, 15),
        "jan 5 24": datetime(2024, 1, 5),
        "5-Jan-24 10:00": datetime(2024, 1, 5, 10),
        "5 Jan 99": datetime(1999, 1, 5),
        "20240105 1015": datetime(2024, 1, 5, 10, 15),
        "20240105T101530": datetime(2024, 1, 5, 10, 15, 30),
        "20240105 9915": None,
        "January 2024": datetime(2024, 1, 1),
        "Jan-2024": datetime(2024, 1, 1),
        "Maint 2024": None,
        "Row 5 2024": None,
    }
    assert column(spark, list(cases), tx.parse_timestamp) == list(cases.values())


def test_values(spark):
    cases = {"Maint.": None, "Power Off": None, " NA ": None, "3.5": 3.5, "-1": -1.0, "abc": None, "": None, "NaN": None, "inf": None, " 7 ": 7.0, "1.5d": None, "1e3": 1000.0, ".5": 0.5, "1e999": None}
    assert column(spark, list(cases), tx.clean_value) == list(cases.values())


def test_stations(spark):
    cases = {
        "Bhatagaon DCR/a.xlsx": "BHATAGAON",
        "DCR AIIMS/a.xlsx": "AIIMS",
        "New Town DCR/a.xlsx": "TOWN",
        "DCR/a.xlsx": "DCR",
        "2024 07/a.xlsx": "2024_07",
        "": "UNKNOWN",
    }
    assert column(spark, list(cases), tx.station_from_path) == list(cases.values())


def test_canonical_names(spark):
    cases = {"PM 2.5_SILTARA": "PM2.5", "SO2SILTARA": "SO2", "NO2__BHATAGAON": "NO2", "pm2_5": "PM2.5", "CO_AIIM": "CO", "WS_IGKV": "WS_IGKV", "PM 10": "PM10"}
    assert column(spark, list(cases), lambda c: tx.canonical_name(c, F.lit("SILTARA"))) == list(cases.values())


def cell_rows(spark, sheets):
    rows = [(f, s, i, c) for (f, s), body in sheets.items() for i, c in enumerate(body)]
    return spark.createDataFrame(rows, "source_file string, source_sheet string, row_idx bigint, cells array<string>")


SHEETS = {
    ("IGKV DCR", "01"): [
        ["title", "", "", "", "", ""],
        ["Date & Time", "NO2", "", "NO2", " PM  10 ", ""],
        ["", "ppb", "", "ppb", "ug", ""],
        ["01-08-2022 00:15", "1.5", "", "Maint.", "-2", ""],
        ["later", "9", "9", "9", "9", "9"],
        ["02-08-2022 00:15"],
    ],
    ("IGKV DCR", "02"): [["no heading", "NO2"], ["01-08-2022 00:15", "1"]],
    ("IGKV DCR", "03"): [["date & time", " "], ["", ""], ["01-08-2022 00:15", "1"]],
    ("IGKV DCR", "04"): [["date & time", "SO2"], ["", ""], ["never", "1"]],
    ("IGKV DCR", "05"): [[], ["date & time", "SO2"]],
}


def test_sheet_layout_and_readings(spark):
    cells = cell_rows(spark, SHEETS)
    names = sh.header_names(cells).where("source_sheet = '01'").orderBy("sheet_column").collect()
    assert [r["variable"] for r in names] == ["NO2", "COL_3", "NO2__2", "PM 10"]
    long = sh.sheet_to_long(cells).where("source_sheet = '01'")
    got = {(r["ts"].day, r["variable"]): r["value"] for r in long.collect()}
    assert got == {(1, "NO2"): 1.5, (1, "COL_3"): None, (1, "NO2__2"): None, (1, "PM 10"): -2.0,
                   (2, "NO2"): None, (2, "COL_3"): None, (2, "NO2__2"): None, (2, "PM 10"): None}
    report = {r["source_sheet"]: (r["n_rows"], r["n_columns"], r["skip_reason"]) for r in sh.ingest_report(cells).collect()}
    assert report == {"01": (2, 8, None), "02": (0, None, "no variable row"), "03": (0, None, "too few columns"),
                      "04": (0, 5, "no data rows"), "05": (0, 5, "no data rows")}


def test_densest_synonym_ties_go_to_the_first_column(spark):
    rows = [("A", "NO2_A", 1.0, 2), ("A", "NO2__X", 1.0, 1), ("A", "SO2", None, 3), ("A", "so2", 2.0, 4)]
    df = spark.createDataFrame(rows, "station string, variable string, value double, place int")
    got = {r["canonical"]: r["variable"] for r in nm.densest_synonyms(df, place="place").collect()}
    assert got == {"NO2": "NO2__X", "SO2": "so2"}
    assert nm.standardize(df, place="place").count() == 2


def test_cell_dumps_keep_row_order_when_files_are_split(spark):
    root = scratch_path(spark, "dump").replace("file:", "")
    os.makedirs(f"{root}/New Town DCR/book+1")
    with open(f"{root}/New Town DCR/book+1/07.tsv", "w") as f:
        f.writelines(f"{i}\tv{i}\t\n" for i in range(20000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        cells = ce.read_cells(spark, root)
        assert cells.rdd.getNumPartitions() >= 1
        bad = cells.where((F.col("cells")[0].cast("bigint") != F.col("row_idx")) | (F.size("cells") != 3))
        assert cells.count() == 20000 and bad.count() == 0
        one = cells.first()
        assert (one["source_file"], one["source_sheet"]) == ("New Town DCR/book+1", "07")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_listing_skips_lock_files(spark):
    root = scratch_path(spark, "files").replace("file:", "")
    os.makedirs(f"{root}/b")
    for name in ("b/z.XLSX", "a.xls", "b/~$z.xlsx", "c.txt"):
        with open(f"{root}/{name}", "w") as f:
            f.write("content")
    names = [r["name"] for r in ce.list_files(spark, root).collect()]
    assert names == ["a.xls", "z.XLSX"]


def test_sheet_filter(spark):
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate(["1", "notes", "02", "3"])], "source_file string, sheet_pos int, source_sheet string")
    assert {r["source_sheet"] for r in sh.filter_sheets(df).collect()} == {"1", "02", "3"}


def test_tables(spark):
    with pytest.raises(FileNotFoundError):
        tb.load_table(spark, scratch_path(spark, "nothing"))
    df = spark.createDataFrame([("A", 1)], "station string, n int")
    with pytest.raises(ValueError, match=r"\['mae', 'rmse'\]"):
        tb.require_columns(df, ["station", "rmse", "mae"])
    other = spark.createDataFrame([("x", "B", 2.0)], "n string, station string, z double")
    merged = tb.union_chunks([df, other])
    assert merged.columns == ["station", "n", "z"]
    assert {tuple(r) for r in merged.collect()} == {("A", 1, None), ("B", None, 2.0)}


def test_metric_records(spark):
    old = spark.createDataFrame([("A", "m1", 1.0), ("A", "m2", 2.0)], "station string, model string, rmse double")
    new = spark.createDataFrame([("A", "m1", 9.0), ("B", "m1", 8.0)], "station string, model string, rmse double")
    once = rec.upsert_metrics(old, new)
    assert sorted(map(tuple, rec.upsert_metrics(once, new).collect())) == [("A", "m1", 9.0), ("A", "m2", 2.0), ("B", "m1", 8.0)]
    assert rec.append_metrics(once, new).count() == 5
    path = scratch_path(spark, "json")
    rec.write_nested_json(new, "station", ["rmse"], path)
    assert sorted(map(tuple, rec.read_nested_json(spark, path).collect())) == [("A", "rmse", 9.0, None), ("B", "rmse", 8.0, None)]


def test_upsert_in_place_cut_short_leaves_all_models(spark):
    path, schema = scratch_path(spark, "metrics"), "station string, rmse double, model string"
    read = lambda: sorted((r["model"], r["station"], r["rmse"]) for r in rec.read_csv(spark, path, schema).collect())
    rec.upsert_in_place(spark.createDataFrame([("A", 1.0, "m1"), ("A", 2.0, "m2"), ("B", 3.0, "m2")], schema), path)
    rows = spark.createDataFrame([("A", 9.0, "m1")], schema)
    rec.upsert_in_place(rows, path)
    rec.upsert_in_place(rows, path)
    whole = [("m1", "A", 9.0), ("m2", "A", 2.0), ("m2", "B", 3.0)]
    assert read() == whole
    broken = spark.range(40).repartition(4).select(F.lit("A").alias("station"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost")).cast("double")).otherwise(5.0).alias("rmse"), F.lit("m2").alias("model"))
    with pytest.raises(Exception, match="lost"):
        rec.upsert_in_place(broken, path)
    assert read() == whole


def test_documents_of_any_depth_are_rows(spark):
    rows = [("A", "x", ({"x": 1.5, "y": 2.0},), 7), ("B", None, ({},), 0)]
    df = spark.createDataFrame(rows, "station string, chosen string, val struct<rmse: map<string, double>>, n bigint")
    path = scratch_path(spark, "json")
    rec.write_nested_json(df, "station", ["chosen", "val", "n"], path)
    got = {(r["station"], r["metric"]): (r["value"], r["text"]) for r in rec.read_nested_json(spark, path).collect()}
    assert got == {
        ("A", "chosen"): (None, "x"),
        ("A", "val.rmse.x"): (1.5, None),
        ("A", "val.rmse.y"): (2.0, None),
        ("A", "n"): (7.0, None),
        ("B", "chosen"): (None, None),
        ("B", "n"): (0.0, None),
    }
    for text in ("[1]", "{oops"):
        broken = scratch_path(spark, "broken")
        spark.createDataFrame([(text,)], "value string").write.text(broken)
        with pytest.raises(Exception):
            rec.read_nested_json(spark, broken).collect()


def test_late_rows_of_a_second_file_are_dropped(spark):
    source, out, checkpoint = (scratch_path(spark, n) for n in ("arriving", "live", "live_checkpoint"))
    schema = "station string, variable string, ts timestamp_ntz, value double"

    def arrive(*rows):
        cells = [("A", "v", START + timedelta(hours=h), v) for h, v in rows]
        spark.createDataFrame(cells, schema).coalesce(1).write.mode("append").parquet(source)
        return jobs.live_grid(spark, source, spark.createDataFrame([], schema).schema, lambda df: df, out, checkpoint)

    arrive((0, 1.0), (5, 2.0))
    done = arrive((0, 99.0), (4.5, 3.0), (9, 4.0))
    # 0:00 is later than the watermark of the first file allows, 4:30 is not.
    assert sorted((r["ts"], r["value"]) for r in done.collect()) == [(START, 1.0), (START + timedelta(hours=4.5), 3.0), (START + timedelta(hours=5), 2.0)]


def test_params_are_fitted_once(spark):
    path, calls = scratch_path(spark, "fit"), []

    def fit():
        calls.append(1)
        return spark.range(3)

    assert tb.fit_or_load(spark, path, fit).count() == 3 and tb.fit_or_load(spark, path, fit).count() == 3
    assert len(calls) == 1


def test_shared_folder_follows_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = shared_folder(spark)
    assert folder == (configured.rstrip("/") if configured else spark.sparkContext.getCheckpointDir().rstrip("/"))
    assert scratch_path(spark, "x").startswith(folder)


def test_drop_staged(spark, monkeypatch):
    folder = session._own_folder(spark) + "-other"
    monkeypatch.setattr(session, "_own_folder", lambda s: folder)
    staged = session.stage_table(spark.range(3), "x")
    assert staged.count() == 3
    session.drop_staged(spark)
    with pytest.raises(FileNotFoundError):
        tb.load_table(spark, folder)


def test_coercions(spark):
    df = spark.createDataFrame([("A", "2024-01-01", "1.5"), ("A", "bad", "2"), (None, "2024-01-01", "3"), ("A", "2024-01-02", "NaN")], "station string, ts string, value string")
    got = nm.coerce_numeric(nm.coerce_keys(df)).orderBy("ts").collect()
    assert [(r["ts"].day, r["value"]) for r in got] == [(1, 1.5), (2, None)]
    signed = spark.createDataFrame([(-1.0,), (0.0,), (2.0,)], "value double")
    assert [r["value"] for r in nm.drop_negatives(signed).collect()] == [None, 0.0, 2.0]


def test_wide_sheets_and_late_headings(spark):
    names = ["Date & Time"] + [f"v{i}" for i in range(1100)]
    rows = [("f", "s", i, ["note"]) for i in range(60)]
    rows += [("f", "s", 60, names), ("f", "s", 61, ["units"]), ("f", "s", 62, ["2024-01-05 10:00"] + [str(i) for i in range(1100)])]
    cells = spark.createDataFrame(rows, "source_file string, source_sheet string, row_idx long, cells array<string>")
    assert sh.sheet_layout(cells).first()["width"] == 1101
    assert sh.sheet_to_long(cells).count() == 1100
    assert sh.variable_rows(cells, preview=50).first()["var_row"] is None


def test_two_digit_years(spark):
    from gridloom.functions.text import parse_timestamp

    df = spark.createDataFrame([("01-08-99",), ("01-08-68",), ("01-08-69",)], "t string").select(parse_timestamp("t").alias("ts"))
    assert [r["ts"].year for r in df.collect()] == [1999, 2068, 1969]


def test_files_are_joined_by_layout_not_one_by_one(spark):
    def scans(root):
        return tb.union_files(spark, root)._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    root = scratch_path(spark, "chunk_files")
    for i in range(6):
        wide = [(str(i), "B", i / 2)] if i % 2 else [(i, "A")]
        schema = "n string, station string, z double" if i % 2 else "n int, station string"
        spark.createDataFrame(wide, schema).coalesce(1).write.parquet(f"{root}/part_{i}")
    merged = tb.union_files(spark, root)
    assert merged.columns == ["station", "n", "z"] and dict(merged.dtypes)["n"] == "int"
    assert {tuple(r) for r in merged.collect()} == {("A", 0, None), ("B", 1, 0.5), ("A", 2, None), ("B", 3, 1.5), ("A", 4, None), ("B", 5, 2.5)}
    assert scans(root) == 2
    same = scratch_path(spark, "same_files")
    for i in range(4):
        spark.createDataFrame([(i, "A")], f"{'nm'[i % 2]} int, station string").coalesce(1).write.parquet(f"{same}/part_{i}")
    assert scans(same) == 1 and {tuple(r) for r in tb.union_files(spark, same).collect()} == {("A", None, 0), ("A", 1, None), ("A", None, 2), ("A", 3, None)}


def test_sheets_are_ingested_once_each(spark):
    root, out, checkpoint = (scratch_path(spark, n).replace("file:", "") for n in ("sheet_dumps", "sheet_rows", "sheet_checkpoint"))

    def arrive(sheet, *values):
        os.makedirs(f"{root}/Bhatagaon DCR/book", exist_ok=True)
        rows = [f"0{i + 1}-08-2022 00:15\t{v}" for i, v in enumerate(values)]
        with open(f"{root}/Bhatagaon DCR/book/{sheet}.txt", "w") as f:
            f.write("\n".join(["Report\t", "Date & Time\tNO2", "\tug/m3", *rows]) + "\n")

    def ingest():
        done = jobs.ingest_sheets(spark, root, out, checkpoint)
        return sorted((r["station"], r["source_sheet"], r["ts"].day, r["value"]) for r in done.collect())

    arrive("01", 1.5, "Maint.")
    first = [("BHATAGAON", "01", 1, 1.5), ("BHATAGAON", "01", 2, None)]
    assert ingest() == first
    arrive("02", 7)
    both = [*first, ("BHATAGAON", "02", 1, 7.0)]
    assert ingest() == both and ingest() == both
    # As if the driver was lost before the second batch was marked as done.
    for name in ("1", ".1.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    assert ingest() == both


def test_sheet_order_is_kept_in_every_partition(spark):
    rows = [(f"s{i % 3}", START + timedelta(minutes=(i * 7919) % 1000), float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, value double").repartition(4)
    placed = sh.in_sheet_order(df).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).toPandas()
    for _, part in placed.groupby("part"):
        part = part.sort_values("place")
        assert [*zip(part.station, part.ts, strict=True)] == sorted(zip(part.station, part.ts, strict=True))
    assert len(placed) == 1000
