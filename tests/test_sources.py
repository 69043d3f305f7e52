"""Readers, sinks, streams and the registered queries."""

from __future__ import annotations

import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orbitrace.sources import tables
from orbitrace.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_plate_and_curation(spark):
    sheet = spark.createDataFrame([("A", "wt", None), ("B", None, "mut")], "row string, `1` string, `2` string")
    assert sorted(map(tuple, tables.plate_map(sheet, "genotype", (1, 2)).collect())) == [("A00", "wt"), ("B01", "mut")]
    plate = spark.createDataFrame([(letter, *(f"{letter}{c}" for c in range(12))) for letter in "ABCDEFGH"], ", ".join(["row string", *(f"`{c}` string" for c in range(1, 13))]))
    named = {r.well_id: r.chem_i for r in tables.plate_map(plate, "chem_i").collect()}
    assert len(named) == 96 and min(named) == "A00" and max(named) == "H11" and named["C07"] == "C7"
    flags = tables.curation(spark.createDataFrame([(3, 1, 0)], "series int, `0` int, `1` int"))
    assert sorted(map(tuple, flags.collect())) == [(3, 0, 1), (3, 1, 0)]
    wells = spark.createDataFrame([("A01", 3, 1, 7200.0)], "well_id string, series int, time_index int, time double")
    plate = spark.createDataFrame([("A01", 24.0)], "well_id string, start_age_hpf double")
    assert tables.frame_metadata(wells, plate, flags).first().stage == 26.0


def test_frame_keys_are_not_cut(spark):
    got = [r.k for r in spark.createDataFrame([(7,), (9999,), (10000,), (10001,), (None,)], "t int").select("t", tables.frame_key(F.col("t")).alias("k")).orderBy(F.asc_nulls_last("t")).collect()]
    assert got == ["t0007", "t9999", "t10000", "t10001", None]


def test_choice_of_run(spark):
    runs = spark.createDataFrame([("a", 0, 100, False), ("b", 0, 200, True), ("c", 50, 60, True)], "run string, start int, stop int, with_flow boolean")
    assert tables.choose_run(runs, 10, 90).first().run == "b" and tables.choose_run(runs, 10, 90, False).first().run == "a"


def test_sinks_skip_or_replace(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.write_table(spark.range(3), path)
    tables.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    tables.write_table(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5
    field = spark.createDataFrame([(8, "density", 0, 1, 2.0)], "nside int, metric string, t_idx int, pix long, value double")
    tables.write_fields(field, f"{tmp_path}/f", {"sigma_um": "25"})
    assert spark.read.parquet(f"{tmp_path}/f/fields").where("nside = 8 AND metric = 'density'").count() == 1
    assert spark.read.parquet(f"{tmp_path}/f/field_attrs").first().value == "25"


def test_tracks_are_read_by_preference(spark, tmp_path):
    rows = spark.createDataFrame([(1, -1, 0, 1.0, 2.0, 3.0)], tables.TRACK_SCHEMA)
    rows.write.parquet(f"{tmp_path}/tracks")
    assert tables.read_tracks(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        tables.read_tracks(spark, str(tmp_path), prefer_smoothed=True).count()
    rows.write.option("header", True).csv(f"{tmp_path}/csv")
    assert tables.read_frames(spark, f"{tmp_path}/csv/*.csv", tables.TRACK_SCHEMA).count() == 1
    with pytest.raises(ValueError, match="missing columns: q"):
        tables.require(rows, "q")


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 3, base + dt.timedelta(minutes=10 * i + (600 if i > 20 else 0)), i // 5) for i in range(40)]
    src = f"{tmp_path}/in"
    spark.createDataFrame(rows, "user_id int, ts timestamp, t int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("user_id int, ts timestamp, t int").parquet(src)
    ingest.ingest_new_frames(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
    ingest.ingest_new_frames(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
    q = ingest.sliding_counts(stream, window="30 minutes", slide="15 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 80
    q = ingest.segments(stream, "user_id", gap="60 minutes").writeStream.format("memory").queryName("segs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("segs").groupBy("user_id").count().where("count <> 2").count() == 0


def test_entry_and_a_few_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert entry.entry(spark).count() > 0
    for name in ("entry_cell_summary", "b12_healpix", "e07_sliding_msd", "c06_radius_pairs", "i01_components", "d09_mean_intensity", "i04_lineage_roots"):
        got = entry.queries()[name](spark, SF).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
        key = lambda d: sorted(d.astype(str).agg("|".join, axis=1))
        assert key(got.astype(float)) == key(want.astype(float)), name


def test_scratch_is_cleared(spark):
    from pathlib import Path as Folder

    from orbitrace.session import clear_scratch, discard, materialize

    a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
    discard(a)
    assert not Folder(a._path).exists() and b.count() == 4
    clear_scratch(spark)
    assert not Folder(b._path).exists()


def test_entry_without_the_corpus_part():
    """The entry module still imports when the corpus subpackage and pipeline are gone."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('orbitrace.llm') or name == 'corpus_pipeline':\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)


def test_run_is_chosen_by_folder_names_alone(spark, tmp_path):
    rows = [(run, flow, i, t) for run, flow, last in (("a", False, 60), ("b c", True, 90), ("d", True, 30)) for i in (1, 2) for t in range(last)]
    k = spark.createDataFrame(rows, "run string, with_flow boolean, track_id long, t int")
    tables.write_runs(k, f"{tmp_path}/named")
    assert {x[1:] for x in tables.run_folders(spark, f"{tmp_path}/named")} == {("a", False, 0, 59), ("b c", True, 0, 89), ("d", True, 0, 29)}
    one = tables.read_run(spark, f"{tmp_path}/named", 5, 40)
    assert one.count() == 72 and {(r.run, r.with_flow) for r in one.collect()} == {("b c", True)} and one.columns == ["track_id", "t", "run", "with_flow"]
    assert all("run=b" in f for f in one.inputFiles())
    # folders that cannot be read are no matter unless they are chosen
    for f in (tmp_path / "named").glob("run=a/**/*.parquet"):
        f.write_bytes(b"no parquet")
    assert tables.read_run(spark, f"{tmp_path}/named", 0, 80).count() == 2 * 81
    with pytest.raises(ValueError):
        tables.read_run(spark, f"{tmp_path}/named", 0, 400)


def test_stream_of_detections_is_linked_as_the_whole_table(spark, tmp_path):
    """Over several files and a restart; the last frame of a key stays open until a later one comes."""
    import random

    from orbitrace.operators.lineage import link_frames
    from orbitrace.streaming import linking

    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for key in ("a", "b"):
        places = {i: [rng.uniform(0, 60) for _ in range(3)] for i in range(40)}
        for t in range(12):
            for i, p in places.items():
                p[:] = [v + rng.gauss(0, 1.5) for v in p]
                if rng.random() < 0.9 and not (key == "b" and t == 5):
                    rows.append((key, base + dt.timedelta(minutes=t), t, i * 7 % 41, *p))
    schema = "well string, ts timestamp, t int, id long, x double, y double, z double"
    whole = spark.createDataFrame(rows, schema)
    want = {(key, r.t, r.id): r.track_id for key in "ab" for r in link_frames(whole.where(f"well = '{key}'").drop("well", "ts"), 6.0).collect()}
    src, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))

    def arrive(low, high):
        whole.where(f"t >= {low} AND t < {high}").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        linking.run_available(linking.link_stream(stream, 6.0, "well"), out, check).awaitTermination(120)
        return {(r.well, r.t, r.id): r.track_id for r in spark.read.parquet(out).collect()}

    got = arrive(0, 4)
    assert got and all(want[k] == v for k, v in got.items())
    arrive(4, 5)
    got = arrive(5, 12)
    assert arrive(12, 13) == got and spark.read.parquet(out).count() == len(got)
    assert got == {k: v for k, v in want.items() if k in got} and {k[1] for k in want} - {k[1] for k in got} <= {11}


def test_pairs_of_two_frames_match_brute_force():
    import numpy as np

    from orbitrace.streaming.linking import near_pairs

    rng = np.random.RandomState(1)
    a, b = rng.randn(80, 3) * 5, rng.randn(70, 3) * 5
    i, j, d = near_pairs(a, b, 2.5)
    whole = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(int(x), int(y)) for x, y in np.argwhere(whole <= 2.5)] and np.allclose(d, whole[i, j])
    assert len(near_pairs(a[:0], b, 1.0)[0]) == 0
