"""Checklists as they come: a zip of tab-separated members, one partition a member, read by line."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldmark.sources.connectors import checklist

# Members of the archive, and the fields that are read of each.
MEMBERS = {
    "taxon": ("id", "scientificName", "acceptedNameUsage", "kingdom", "taxonomicStatus"),
    "distribution": ("id", "countryCode", "occurrenceStatus", "establishmentMeans"),
    "speciesprofile": ("id", "isInvasive", "habitat"),
}
SCHEMA = "member string, line long, fields map<string, string>"


class Member(InputPartition):
    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.name = name


def opened(path: str):
    """A file that can be sought in, by a path or an address that pyarrow knows."""
    from pyarrow import fs

    at, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return at.open_input_file(place)


class ArchiveReader(DataSourceReader):
    """A member's lines, quotes taken as they are; a line with too few fields lacks the last ones, and empty lines don't count."""

    def __init__(self, path: str, wanted: str | None) -> None:
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[Member]:
        return [Member(m) for m in MEMBERS if self.wanted in (None, m)]

    def read(self, partition: Member) -> Iterator[tuple]:
        with opened(self.path) as file, zipfile.ZipFile(file) as archive:
            name = f"{partition.name}.txt"
            if name not in archive.namelist():
                return
            with archive.open(name) as member:
                header: list[str] | None = None
                for line, text in enumerate(io.TextIOWrapper(member, encoding="utf-8", newline="\n")):
                    text = text.rstrip("\r\n")
                    if not text:
                        continue
                    if header is None:
                        header = text.split("\t")
                    else:
                        yield partition.name, line, dict(zip(header, text.split("\t"), strict=False))


class Archive(DataSource):
    """Register it, then ``spark.read.format("checklist_archive").load(path)``: (member, line, fields); the option ``member`` reads one alone."""

    @classmethod
    def name(cls) -> str:
        return "checklist_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("member"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A zipped checklist, with the rows that its unpacked folder has. A missing member has no rows."""
    spark.dataSource.register(Archive)
    members = {}
    for member, fields in MEMBERS.items():
        lines = spark.read.format(Archive.name()).option("member", member).load(path)
        # An empty field is none, as in a file that is read as a table.
        members[member] = lines.select(*[F.nullif(F.col("fields")[f], F.lit("")).alias(f) for f in fields])
    return checklist(members["taxon"], members["distribution"], members["speciesprofile"])
