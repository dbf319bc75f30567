"""Typed readers and writers of traces, discs, outlines and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that every trace table needs, with their types.
TRACE_FIELDS = {
    "set_id": "int", "face_id": "int", "observed_length_m": "double", "censoring_class": "int",
    "p0_y": "double", "p0_z": "double", "p1_y": "double", "p1_z": "double",
}
DISC_SCHEMA = "set_id int, cx double, cy double, cz double, nx double, ny double, nz double, radius double"
CONFIG_SCHEMA = (
    "dataset_name string, sets map<string, struct<dist_type:string, trend:double, plunge:double, kappa:double,"
    " p32_base:double, r0:double, kr_hat_estimated:double>>"
)
DOMAIN_SCHEMA = (
    "fractures array<struct<id:long, set_id:int, label:string, center_xyz_m:array<double>, normal_xyz:array<double>,"
    " radius_m:double, reconstruction:string, radius_status:string>>"
)

#: Discs of one domain document, and most tasks that write documents at a time.
DOMAIN_DISCS = 20_000
DOMAIN_TASKS = 1_000


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` if it has ``columns``; the missing ones are named otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point columns with null in place of not-a-number."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_traces_csv(spark: SparkSession, path: str) -> DataFrame:
    """A trace table with a header; text that isn't a number becomes null."""
    raw = require(spark.read.csv(path, header=True), list(TRACE_FIELDS))
    kinds = TRACE_FIELDS | ({"radius_m": "double"} if "radius_m" in raw.columns else {})
    return nan_to_null(raw.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in kinds.items()]))


def read_traces(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet trace table; only ``columns`` are scanned."""
    df = spark.read.parquet(path)
    return nan_to_null(require(df, columns).select(*columns) if columns else require(df, list(TRACE_FIELDS)))


def read_discs(spark: SparkSession, path: str, adoption: list[str] | None = None) -> DataFrame:
    """A disc table as CSV, kept to some ``adoption`` values if given."""
    raw = spark.read.csv(path, header=True)
    fields = [f.split() for f in DISC_SCHEMA.split(", ")]
    require(raw, [c for c, _ in fields] + (["adoption"] if adoption else []))
    kept = raw.filter(F.col("adoption").isin(adoption)) if adoption else raw
    others = [c for c in ("adoption", "radius_status") if c in raw.columns]
    return nan_to_null(kept.select(*[F.col(c).try_cast(kind).alias(c) for c, kind in fields], *others))


def polyline_traces(df: DataFrame, vertices: str = "polyline") -> DataFrame:
    """Rows whose polyline has two vertices or more, with its ends."""
    v = F.col(vertices)
    return df.filter(F.size(v) >= 2).withColumns({"p0": F.element_at(v, 1), "p1": F.element_at(v, -1)})


def read_outline(spark: SparkSession, path: str, scale: float = 0.001) -> DataFrame:
    """``(line, y, z)`` of the number pairs ``(y, z)`` in a text file, scaled
    from millimetres to metres."""
    text = spark.read.text(path, wholetext=True)
    number = r"(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"
    pattern = rf"\(\s*{number}\s*,\s*{number}\s*\)"
    pairs = F.arrays_zip(
        F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("y"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("z")
    )
    return text.select(F.posexplode(pairs).alias("line", "p")).select(
        "line", (F.col("p.y").cast("double") * scale).alias("y"), (F.col("p.z").cast("double") * scale).alias("z")
    )


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z`` of an ASCII point cloud's body; header lines hold words."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    numbers = lines.filter(F.size("p") >= 3).select(*[F.col("p")[k].try_cast("double").alias(c) for k, c in enumerate("xyz")])
    return numbers.dropna()


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A row per set of a dataset configuration."""
    doc = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=True)
    return doc.select("dataset_name", F.explode("sets").alias("set_key", "s")).select("dataset_name", "set_key", "s.*")


def read_domain(spark: SparkSession, path: str, top: int | None = None, sets: list[int] | None = None) -> DataFrame:
    """Discs of a domain document, or of all in a folder: the ``top`` largest of
    some ``sets``."""
    discs = spark.read.schema(DOMAIN_SCHEMA).json(path, multiLine=True).select(F.explode("fractures").alias("f")).select("f.*")
    if sets:
        discs = discs.filter(F.col("set_id").isin(sets))
    return discs.orderBy(F.desc("radius_m"), "id").limit(top) if top else discs


def from_folders(df: DataFrame, pattern: str = r"/(\d+)/[^/]*$", name: str = "face") -> DataFrame:
    """``df`` with the number its file's folder is named by."""
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), pattern, 1).try_cast("int"))


def with_defaults(df: DataFrame, *sources: tuple[DataFrame, str], key: str, default: Column) -> DataFrame:
    """``df`` with ``value`` from the first of ``sources`` (table, column) that
    has one for ``key``, else ``default``."""
    out, names = df, []
    for k, (table, column) in enumerate(sources):
        names.append(f"_v{k}")
        out = out.join(table.select(key, F.col(column).alias(names[-1])), key, "left")
    return out.withColumn("value", F.coalesce(*names, default)).drop(*names)


def write_traces(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, a folder per set."""
    df.write.mode(mode).partitionBy("set_id").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with the columns in a fixed order."""
    require(df, columns).select(*columns).write.csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """JSON lines, a document per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def keep_rows(df: DataFrame, ids: DataFrame, key: str, path: str) -> None:
    """Write the rows whose ``key`` is among ``ids``."""
    df.join(ids.select(key).distinct(), key, "left_semi").write.parquet(path)


def read_mesh(spark: SparkSession, vertices: str, triangles: str) -> DataFrame:
    """Triangles with their corners, from a vertex table ``(mesh, vertex, x,
    y, z)`` and a triangle table ``(mesh, triangle, a, b, c)``; a triangle
    that names a missing vertex is an error."""
    v = require(spark.read.parquet(vertices), ["mesh", "vertex", "x", "y", "z"])
    out = require(spark.read.parquet(triangles), ["mesh", "triangle", "a", "b", "c"])
    for corner in "abc":
        point = v.select("mesh", F.col("vertex").alias(corner), F.struct("x", "y", "z").alias(f"{corner}_at"))
        out = out.join(point, ["mesh", corner], "left")
    whole = F.col("a_at").isNotNull() & F.col("b_at").isNotNull() & F.col("c_at").isNotNull()
    return out.filter(F.when(whole, True).otherwise(F.raise_error(F.lit("a triangle names a missing vertex"))))


def read_aligned(spark: SparkSession, left: str, right: str, key: str) -> DataFrame:
    """CSV files whose rows belong together by position, in folders of equal
    names; the ``key`` of both has to agree.  Rows are numbered by their order
    in the folder's files."""

    def numbered(path: str, name: str) -> DataFrame:
        raw = spark.read.csv(path, header=True)
        at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
        rows = raw.select(F.struct(*raw.columns).alias(name), at.alias("_at"), F.regexp_extract(F.input_file_name(), r"([^/]*)/[^/]*$", 1).alias("_folder"))
        return rows.select("_folder", F.row_number().over(Window.partitionBy("_folder").orderBy("_at")).alias("_row"), name)

    both = numbered(left, "l").join(numbered(right, "r"), ["_folder", "_row"], "full_outer")
    alike = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & F.col("l").isNotNull() & F.col("r").isNotNull()
    checked = both.filter(F.when(alike, True).otherwise(F.raise_error(F.concat(F.lit(f"{key} differs in row "), F.col("_row").cast("string")))))
    others = [F.col(f"r.{c}") for c in both.schema["r"].dataType.names if c != key]
    return checked.select(F.col("_folder").alias("folder"), F.col("_row").alias("row"), "l.*", *others)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Voxel labels of all runs, a folder ``run=<seed>`` each."""
    return require(spark.read.parquet(path), ["run", "ix", "iy", "iz"])


def observed_by_face(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces as a list per face, which is bounded by one face's traces, and
    total length per set."""
    lists = traces.groupBy("face_id").agg(F.sort_array(F.collect_list("trace_id")).alias("traces"))
    return lists, traces.groupBy("set_id").agg(F.sum("len").alias("length"))


def face_positions(traces: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Positions of the faces: those declared, or else those that occur."""
    if declared is not None and declared.limit(1).count():
        return declared.select("face_x").distinct()
    return traces.select("face_x").distinct()


def write_domain(discs: DataFrame, path: str, meta: Column, most: int = DOMAIN_DISCS) -> None:
    """A domain document that ``read_domain`` reads: ``meta`` and a list of all
    discs.  More than about ``most`` discs are dealt by their id to several
    documents, each with ``meta``, in a folder each."""
    fractures = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ("id", "set_id", "label", "center_xyz_m", "normal_xyz", "radius_m", "reconstruction", "radius_status")])))
    document = F.to_json(F.struct(meta.alias("meta"), fractures.alias("fractures"))).alias("value")
    parts = -(-discs.count() // most)
    if parts <= 1:
        discs.agg(document).coalesce(1).write.text(path)
        return
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    documents = discs.withColumn("part", part).repartition(min(parts, DOMAIN_TASKS), "part").groupBy("part").agg(document)
    documents.write.partitionBy("part").text(path)


def write_runs(voxels: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Voxel labels as Parquet, a folder per run; other runs stay when
    ``mode`` is "append"."""
    voxels.write.mode(mode).partitionBy("run").parquet(path)


def missing_keys(wanted: DataFrame, done: str, keys: list[str]) -> DataFrame:
    """The rows of ``wanted`` whose ``keys`` an earlier run has not written
    under ``done``: a sweep resumes with these and appends."""
    jvm = wanted.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(done)
    if not path.getFileSystem(wanted.sparkSession._jsc.hadoopConfiguration()).exists(path):
        return wanted
    return wanted.join(wanted.sparkSession.read.parquet(done).select(*keys).distinct(), keys, "left_anti")
