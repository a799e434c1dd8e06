"""Tables that appear whole or not at all, and typed CSV scans that lose no line.

A staged table is a folder with `data/<unique>` and `manifests/<version>.json`. A commit writes its data
first and its manifest last; readers go by the manifest, so the files of an unfinished or failed
commit are never read, and a reader of an earlier version is not disturbed by a new one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelforge.operators.ordered import Order
from panelforge.session import file_system
from panelforge.sources.readers import CSV_TEXT
from panelforge.sources.writers import write_table


class StagedTable:
    """One committer at a time, any number of readers.

    Two commits at once are not ordered by this class: the later one raises when it finds its version
    taken, and its data stays unread.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Committed versions, ascending; empty before the first commit."""
        fs, place = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(place):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        versions = self.versions()
        if not versions or (version is not None and version not in versions):
            raise FileNotFoundError(f"no committed version {version or ''} in {self.path}")
        line = self.spark.read.text(self._manifest(versions[-1] if version is None else version))
        return json.loads(line.first()[0])

    def commit(
        self,
        df: DataFrame,
        fmt: str = "parquet",
        partition_by: Sequence[str] = (),
        index: tuple[str, Order] | None = None,
        counted: dict[str, Column] | None = None,
    ) -> dict:
        """Write a frame as the next version and return its manifest. (CSV reads an empty text as null.)

        Rows, and those that meet each condition of `counted`, are counted by the write itself. The
        stored schema has the written columns in order, so CSV files need no inference.
        """
        version = (self.versions() or [0])[-1] + 1
        data = f"data/{os.urandom(8).hex()}"
        seen = Observation()
        counts = {"rows": F.lit(True), **(counted or {})}
        watched = df.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()])
        schema = write_table(watched, f"{self.path}/{data}", fmt, partition_by, index)
        made = {
            "version": version,
            "data": data,
            "format": fmt,
            "schema": json.loads(schema.json()),
            "counts": {n: int(seen.get[n]) for n in counts},
        }
        self._publish(version, json.dumps(made))
        return made

    def read(self, version: int | None = None) -> DataFrame:
        made = self.manifest(version)
        reader = self.spark.read.schema(StructType.fromJson(made["schema"])).format(made["format"])
        if made["format"] == "csv":
            reader = reader.options(header=True, mode="FAILFAST", **CSV_TEXT)
        return reader.load(f"{self.path}/{made['data']}")

    def vacuum(self) -> int:
        """Remove data that no manifest names; for use while nothing is being committed."""
        named = {self.manifest(v)["data"] for v in self.versions()}
        fs, place = file_system(self.spark, f"{self.path}/data")
        found = [f.getPath() for f in fs.listStatus(place)] if fs.exists(place) else []
        loose = [p for p in found if f"data/{p.getName()}" not in named]
        for p in loose:
            fs.delete(p, True)
        return len(loose)

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def _publish(self, version: int, text: str) -> None:
        fs, final = file_system(self.spark, self._manifest(version))
        _, draft = file_system(self.spark, f"{self.path}/manifests/_{os.urandom(8).hex()}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} was committed by another writer")


def ingest_csv(
    spark: SparkSession,
    source: str,
    schema: str,
    target: StagedTable,
    required: Sequence[str] = (),
    header: bool = True,
    multiline: bool = False,
    null_text: str = "",
) -> dict:
    """Parse CSV files once into a staged table that holds the good and the bad lines apart.

    A line is bad if its number of fields is wrong, if a field is not of its column's type, or if it
    lacks a required column; the first of these is the `reason`. Fields are read as text and cast
    here, so `raw` keeps a bad line's fields as they stood; its typed columns are null, and
    nothing half read can slip into results. Returns the manifest with the numbers of rows and bad
    rows. Fields in quotes may hold commas and doubled quotes, and line ends with `multiline`, which
    reads each file in one task. Empty fields, in quotes or not, are null, as `null_text` is.
    """
    wanted = StructType.fromDDL(schema)
    clash = {"raw", "reason", "bad"} & set(wanted.names)
    if clash:
        raise ValueError(f"columns of this name are made here: {sorted(clash)}")
    texts = StructType([StructField(n, StringType()) for n in [*wanted.names, "raw"]])
    lines = (
        spark.read.schema(texts)
        .options(
            header=header,
            enforceSchema=True,
            mode="PERMISSIVE",
            columnNameOfCorruptRecord="raw",
            columnPruning=False,  # whether a line is bad must not hang on the columns asked for
            multiLine=multiline,
            **CSV_TEXT,
        )
        .csv(source)
    )
    texts_of = {f.name: F.col(f"`{f.name}`") for f in wanted}
    known = {n: F.when((c != "") & (c != null_text), c) for n, c in texts_of.items()}
    typed = {f.name: known[f.name].try_cast(f.dataType) for f in wanted}
    reasons = [F.when(F.col("raw").isNotNull(), F.lit("wrong number of fields"))]
    for f in wanted:
        wrong = known[f.name].isNotNull() & typed[f.name].isNull()
        reasons.append(F.when(wrong, F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
    reasons += [F.when(known[c].isNull(), F.lit(f"{c} is missing")) for c in required]
    rows = lines.withColumn("reason", F.coalesce(*reasons)).withColumn("bad", F.col("reason").isNotNull())
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    as_read = F.to_csv(F.struct(*texts_of.values()), {**CSV_TEXT, **blanks})
    return target.commit(
        rows.select(
            *[F.when(~F.col("bad"), c).alias(n) for n, c in typed.items()],
            F.when(F.col("bad"), F.coalesce("raw", as_read)).alias("raw"),
            "reason",
            "bad",
        ),
        partition_by=["bad"],
        counted={"bad": F.col("bad")},
    )


def good_rows(target: StagedTable, version: int | None = None) -> DataFrame:
    """The typed rows of an ingested CSV; the bad part's files are not opened."""
    return target.read(version).filter("not bad").drop("raw", "reason", "bad")


def bad_rows(target: StagedTable, version: int | None = None) -> DataFrame:
    """`raw`, `reason` of the quarantined lines."""
    return target.read(version).filter("bad").select("raw", "reason")
