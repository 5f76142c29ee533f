"""Source trees as tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.functions import ids, paths

LARGEST_FILE = 10 * 1024 * 1024


def checked_root(root: str, allowed: Sequence[str]) -> str:
    """A root inside one of the allowed folders, after links and ``..`` are resolved."""
    full = os.path.realpath(root)
    for a in map(os.path.realpath, allowed):
        if full == a or full.startswith(a.rstrip("/") + "/"):
            return full
    raise PermissionError(f"{root} is outside the allowed folders")


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Text files under a root: ``path``, ``language``, ``size``, ``mtime``, ``content``, ``content_hash``.

    Size is checked before content is read; binary files (with a NUL byte) are dropped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = raw.filter(F.col("length") <= LARGEST_FILE)
    if extensions:
        rows = rows.filter(paths.extension(F.col("path")).isin([e.lstrip(".").lower() for e in extensions]))
    for scope in exclude:
        rows = rows.filter(~paths.matches_scope(F.col("path"), scope))
    rows = rows.filter(~F.contains("content", F.lit(b"\x00")))
    text = F.decode("content", "UTF-8")
    return rows.select(
        paths.normal_path(F.col("path")).alias("path"),
        paths.language_of(F.col("path")).alias("language"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"),
        text.alias("content"),
        ids.content_hash(text).alias("content_hash"),
    )


def project_references(files: DataFrame) -> DataFrame:
    """Projects of solution files and references of project files: ``path``, ``kind``, ``target``."""
    solutions = files.filter(paths.extension(F.col("path")) == "sln").select(
        "path", F.lit("project").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(r'Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+)"'), F.lit(1))).alias("target")
    )
    projects = files.filter(paths.extension(F.col("path")).isin("csproj", "vbproj"))
    refs = projects.select("path", F.lit("reference").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(r'<ProjectReference\s+Include="([^"]+)"'), F.lit(1))).alias("target"))
    packages = projects.select("path", F.lit("package").alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(r'<PackageReference\s+Include="([^"]+)"'), F.lit(1))).alias("target"))
    return solutions.unionByName(refs).unionByName(packages).withColumn("target", paths.normal_path(F.col("target")))


def snapshot_history(spark: SparkSession, root: str) -> DataFrame:
    """Zip snapshots as pseudo commits: ``snapshot``, ``path``, ``status``.

    Each archive is opened once, in its own task; consecutive snapshots are compared by a window per path.
    """
    import io
    import zipfile

    import pyarrow as pa
    from pyspark.sql.window import Window

    def members(batches):
        import hashlib

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            with z.open(m) as f:
                                rows.append((path.rsplit("/", 1)[-1].removesuffix(".zip"), m.filename, hashlib.sha256(f.read()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, ["snapshot", "path", "hash"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(root).select("path", "content")
    held = raw.mapInArrow(members, "snapshot string, path string, hash string")
    turns = held.select("snapshot").distinct().withColumn("turn", F.row_number().over(Window.orderBy("snapshot")))  # one row per archive
    rows = held.join(turns, "snapshot")
    w = Window.partitionBy("path").orderBy("turn")
    rows = rows.withColumns({"old": F.lag("hash").over(w), "old_turn": F.lag("turn").over(w), "next": F.lead("turn").over(w)})
    came = rows.filter("old IS NULL OR old_turn < turn - 1 OR old != hash").select("turn", "path", F.when(F.col("old").isNull() | (F.col("old_turn") < F.col("turn") - 1), "added").otherwise("modified").alias("status"))
    last = turns.agg(F.max("turn").alias("last"))
    went = rows.crossJoin(F.broadcast(last)).filter("turn < last AND (next IS NULL OR next > turn + 1)").select((F.col("turn") + 1).alias("turn"), "path", F.lit("removed").alias("status"))
    return came.unionByName(went).join(turns, "turn").select("snapshot", "path", "status")
