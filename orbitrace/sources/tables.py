"""Readers, assembled tables and sinks."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK_SCHEMA = "track_id long, parent_track_id long, t int, x double, y double, z double"


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_tracks(spark: SparkSession, folder: str, prefer_smoothed: bool = False, kind: str = "parquet") -> DataFrame:
    """``tracks`` of a run folder, or ``tracks_smoothed``; a preferred table that is absent is an error of the read."""
    path = f"{folder}/{'tracks_smoothed' if prefer_smoothed else 'tracks'}"
    reader = spark.read.schema(TRACK_SCHEMA)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.parquet(path)


def read_frames(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Many per-frame CSV files as one table, with the file each row came from."""
    return spark.read.schema(schema).option("header", True).csv(glob).withColumn("source_file", F.input_file_name())


def choose_run(runs: DataFrame, first: int, last: int, prefer_flow: bool = True) -> DataFrame:
    """The run that covers a frame range with the fewest frames beyond it; with flow first if preferred."""
    fits = runs.where((F.col("start") <= first) & (F.col("stop") >= last))
    flow = F.col("with_flow").cast("int")
    return fits.orderBy(F.desc(flow) if prefer_flow else flow, F.col("stop") - F.col("start"), "run").limit(1)


def run_folders(spark: SparkSession, root: str) -> list[tuple[str, str, bool, int | None, int | None]]:
    """``path, run, with_flow, start, stop`` of the runs under ``root``, told by the names of their folders alone:
    ``run=.../with_flow=...`` and below it ``frames=<first>_<last>`` where the writer named them, else the range is None."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for folder in files.globStatus(path(f"{root}/run=*/with_flow=*")) or []:
        at = folder.getPath()
        run, flow = unquote(at.getParent().getName()[4:]), at.getName()[10:].lower() == "true"
        below = files.globStatus(path(f"{at.toString()}/frames=*")) or []
        for one in below:
            first, last = one.getPath().getName()[7:].split("_")
            found.append((one.getPath().toString(), run, flow, int(first), int(last)))
        if not below:
            found.append((at.toString(), run, flow, None, None))
    return found


def write_runs(tracks: DataFrame, root: str) -> None:
    """Tracks with ``run`` and ``with_flow`` as folders that name each run's frames, in the form that ``read_run`` chooses from."""
    bounds = tracks.groupBy("run", "with_flow").agg(F.format_string("%04d_%04d", F.min("t"), F.max("t")).alias("frames"))
    write_table(tracks.join(bounds, ["run", "with_flow"]), root, partition_by=("run", "with_flow", "frames"))


def read_run(spark: SparkSession, root: str, first: int, last: int, prefer_flow: bool = True) -> DataFrame:
    """Tracks of the run under ``root`` (Parquet, in folders ``run=.../with_flow=.../frames=<first>_<last>``) that ``choose_run``
    takes for the frames asked for, with ``run`` and ``with_flow``.

    The choice is made from the folder names, one per run, so nothing is scanned before and only that run's folder is read,
    with its frames filtered by the reader. Of runs whose folders name no frames, the frame column is read for its bounds.
    """
    runs = run_folders(spark, root)
    known = {(run, flow): (start, stop) for _, run, flow, start, stop in runs if start is not None}
    for path, run, flow, start, _ in runs:
        if start is None:
            known[run, flow] = tuple(spark.read.parquet(path).agg(F.min("t"), F.max("t")).first())
    rows = [(run, flow, *bounds) for (run, flow), bounds in known.items()]
    found = choose_run(spark.createDataFrame(rows, "run string, with_flow boolean, start int, stop int"), first, last, prefer_flow).first()
    if found is None:
        raise ValueError(f"no run covers frames {first} to {last}")
    folder = next(path for path, run, flow, *_ in runs if (run, flow) == (found.run, found.with_flow))
    out = spark.read.option("basePath", root).parquet(folder).withColumns({"run": F.col("run").cast("string"), "with_flow": F.col("with_flow").cast("boolean")})
    return out.where((F.col("run") == found.run) & F.col("t").between(first, last)).drop("frames")


ATTRIBUTES = "voxel_size_um array<double>, time_resolution_s double, channels array<string>"


def dataset_attributes(texts: DataFrame, column: str = "attributes") -> DataFrame:
    """Other columns and the attributes of a dataset from their JSON text: voxel size (z, y, x), time step in seconds and
    minutes, channel names. A missing attribute, or a text that is no JSON, is null."""
    read = F.from_json(column, ATTRIBUTES)
    out = texts.withColumn("__a", read).select(*(c for c in texts.columns if c != column), "__a.*")
    return out.withColumn("time_resolution_min", F.col("time_resolution_s") / 60)


def read_attributes(spark: SparkSession, glob: str) -> DataFrame:
    """Attributes of the datasets whose attribute files ``glob`` names, with the file each came from."""
    texts = spark.read.text(glob, wholetext=True).withColumnRenamed("value", "attributes")
    return dataset_attributes(texts.withColumn("source_file", F.input_file_name()))


def augment_tracks(tracks: DataFrame, field: DataFrame, nside: int, stride: float, time: str = "time_min", t_min: float = 0.0) -> DataFrame:
    """``tracks`` (with ``theta, phi``) and the metrics of a wide field (``t_idx, pix`` and one column a metric) at each row's
    pixel and the window with the nearest centre (the earlier of two). Where the field has no row the metrics are null."""
    from orbitrace.functions.healpix import with_pixel

    last = field.agg(F.max("t_idx").alias("m")).first().m
    at = F.ceil((F.col(time) - t_min) / stride - 0.5)
    rows = with_pixel(tracks, nside).withColumn("t_idx", F.least(F.greatest(at, F.lit(0)), F.lit(last or 0)).cast("int"))
    return rows.join(field, ["t_idx", "pix"], "left")


def assemble_tracks(
    tracks: DataFrame, classes: DataFrame | None = None, dropped: DataFrame | None = None, dropped_classes: DataFrame | None = None, fluorescence: DataFrame | None = None,
    clusters: DataFrame | None = None, voxel_size: dict[str, float] | None = None, channel: int = 0,
) -> DataFrame:
    """Tracks with what else is known: dropped cells appended and flagged, coordinates scaled, class per track, class per
    dropped row, one channel's fluorescence, and the cluster that holds each row. Missing tables are left out."""
    out = require(tracks, "track_id", "t").withColumn("is_dropped", F.lit(False))
    if dropped is not None:
        out = out.unionByName(dropped.withColumn("is_dropped", F.lit(True)), allowMissingColumns=True)
    if voxel_size:
        out = out.withColumns({a: F.col(a) * F.lit(float(s)) for a, s in voxel_size.items()})
    if classes is not None:
        out = out.join(classes.select("track_id", "track_class"), "track_id", "left")
    if dropped_classes is not None:
        out = out.join(dropped_classes.select("track_id", "t", F.col("frame_class").alias("frame_class_dropped")), ["track_id", "t"], "left")
    if fluorescence is not None:
        out = out.join(fluorescence.where(F.col("channel") == channel).select("track_id", "t", "mean_fluo"), ["track_id", "t"], "left")
    if clusters is not None:
        members = clusters.select("t", "cluster_id", F.explode("member_track_id").alias("track_id"))
        out = out.join(members, ["t", "track_id"], "left")
    return out


def channel_index(channels: F.Column | str = "channels"):
    """Columns: place of the first channel whose upper-case name has H2B or NLS (null if none), and of the first other."""
    c = F.col(channels) if isinstance(channels, str) else channels
    nuclear = F.transform(c, lambda n: F.upper(n).contains("H2B") | F.upper(n).contains("NLS"))
    first = lambda flag: F.when(F.array_position(nuclear, flag) > 0, F.array_position(nuclear, flag) - 1)
    return first(F.lit(True)), first(F.lit(False))


def frame_key(t):
    """Column: ``t`` and the frame with leading zeros to four digits; longer numbers are written whole, null stays null."""
    return F.when(t.isNotNull(), F.format_string("t%04d", t.cast("long")))


def plate_map(sheet: DataFrame, value: str, columns=range(1, 13), row: str = "row") -> DataFrame:
    """A wide plate sheet (a row letter and one column per plate column) to ``well_id, value``; empty wells go.

    Wells are named by row letter and the place of their column from 00, so a full plate is ``A00`` to ``H11``.
    """
    wide = sheet.select(row, *(F.col(str(c)).cast("string").alias(f"{k:02d}") for k, c in enumerate(columns)))
    long = wide.unpivot(row, [c for c in wide.columns if c != row], "col", value).where(F.col(value).isNotNull())
    return long.select(F.concat(F.col(row), F.col("col")).alias("well_id"), value)


def curation(sheet: DataFrame, key: str = "series") -> DataFrame:
    """A wide curation sheet (a column per time index) to ``series, time_index, qc_flag``."""
    times = [c for c in sheet.columns if c != key]
    long = sheet.unpivot(key, times, "time_index", "qc_flag")
    return long.select(key, F.col("time_index").cast("int").alias("time_index"), "qc_flag")


def frame_metadata(wells: DataFrame, plate: DataFrame, flags: DataFrame) -> DataFrame:
    """Well rows with plate data and flags; ``stage`` is the start age plus hours since the start."""
    out = wells.join(plate, "well_id", "left").join(flags, ["series", "time_index"], "left")
    return out.withColumn("stage", F.col("start_age_hpf") + F.col("time") / 3600)


def frames_to_do(source: DataFrame, written: DataFrame, frame: str = "t") -> DataFrame:
    """Rows of the frames that are not written yet."""
    return source.join(written.select(frame).distinct(), frame, "left_anti")


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by=()) -> None:
    """Writes unless the table is there already, or over it if told to."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sorted(tracks: DataFrame, path: str, overwrite: bool = False, keys=("track_id", "t")) -> None:
    """Tracks in files that follow each other in the order of ``keys``, each sorted inside: a range deal and a local sort."""
    write_table(tracks.repartitionByRange(*keys).sortWithinPartitions(*keys), path, overwrite)


def write_foreground(voxels: DataFrame, path: str, overwrite: bool = False) -> None:
    """Foreground voxels partitioned by frame."""
    write_table(voxels.where("label > 0"), path, overwrite, ("t",))


def write_fields(field: DataFrame, path: str, attributes: dict[str, str], overwrite: bool = False) -> None:
    """Long fields by ``nside`` and ``metric``, with units and grid parameters in a table beside them."""
    write_table(field, f"{path}/fields", overwrite, ("nside", "metric"))
    rows = sorted((str(k), str(v)) for k, v in attributes.items())
    write_table(field.sparkSession.createDataFrame(rows, "name string, value string"), f"{path}/field_attrs", overwrite)


def write_coefficients(coeffs: DataFrame, path: str) -> None:
    """Harmonic coefficients as JSON lines, one a frame."""
    coeffs.write.mode("overwrite").json(path)
