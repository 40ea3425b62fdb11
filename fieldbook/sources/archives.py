"""XML and GML inside archives, as a data source: one partition a member, parsed as a stream.

The driver reads an archive's directory of members only. Each task opens the archive itself, goes to its member and yields a row for each ``rowTag`` element
as it ends, so neither an archive nor a member is ever whole in memory. Files are opened through pyarrow's file systems, which know local paths and
object stores by their scheme.
"""

from __future__ import annotations

import fnmatch
import gzip
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType, TimestampType

RINGS = "array<array<struct<x:double,y:double>>>"


@dataclass
class Member(InputPartition):
    path: str
    name: str | None


def _files(path: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+://|file:/", path) else (fs.LocalFileSystem(), path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.Directory:
        return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File)
    return system, [at]


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _value(text: str | None, kind: DataType):
    text = text.strip() if text else None
    if not text:
        return None
    if isinstance(kind, (LongType, IntegerType, ShortType)):
        return int(text)
    if isinstance(kind, (DoubleType, FloatType)):
        return float(text)
    if isinstance(kind, BooleanType):
        return text.lower() in ("true", "1")
    if isinstance(kind, DateType):
        import datetime as dt

        return dt.date.fromisoformat(text[:10])
    if isinstance(kind, TimestampType):
        import datetime as dt

        return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return text


def _points(element: ElementTree.Element) -> list[tuple[float, float]]:
    """Coordinates of a posList, pos or coordinates element, without heights."""
    tag, text = local_name(element.tag), element.text or ""
    if tag == "coordinates":
        return [tuple(map(float, p.split(",")[:2])) for p in text.split()]
    width = int(element.get("srsDimension") or 2)
    numbers = list(map(float, text.split()))
    return [(numbers[k], numbers[k + 1]) for k in range(0, len(numbers) - 1, width)]


def gml_rings(element: ElementTree.Element) -> list[list[tuple[float, float]]]:
    """All rings of the polygons in an element, shells and holes; a dimension named at the geometry holds for its rings."""
    width = next((e.get("srsDimension") for e in element.iter() if e.get("srsDimension")), None)
    out = []
    for ring in (e for e in element.iter() if local_name(e.tag) == "LinearRing"):
        points = []
        for e in ring.iter():
            if local_name(e.tag) in ("posList", "pos", "coordinates"):
                if width and not e.get("srsDimension"):
                    e.set("srsDimension", width)
                points += _points(e)
        out.append(points)
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.row_tag, self.pattern = options["rowtag"], options.get("members", "*.xml")

    def partitions(self) -> list[Member]:
        out = []
        system, files = _files(self.path)
        for path in files:
            if path.lower().endswith(".zip"):
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                    out += [Member(path, m.filename) for m in archive.infolist() if not m.is_dir() and fnmatch.fnmatch(m.filename.lower(), self.pattern.lower())]
            else:
                out.append(Member(path, None))
        return out or [Member("", None)]

    def read(self, partition: Member) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _files(self.path)
        with system.open_input_file(partition.path) as f:
            if partition.name is not None:
                with zipfile.ZipFile(f) as archive, archive.open(partition.name) as member:
                    yield from self.rows(member)
            elif partition.path.lower().endswith(".gz"):
                with gzip.open(f) as member:
                    yield from self.rows(member)
            else:
                yield from self.rows(f)

    def rows(self, stream) -> Iterator[tuple]:
        around = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                around.append(element)
                continue
            around.pop()
            if local_name(element.tag) == self.row_tag:
                yield self.row(element)
                if around:
                    around[-1].clear()  # a row that was given is not kept in its parent

    def row(self, element: ElementTree.Element) -> tuple:
        by_name = {}
        for e in element.iter():
            by_name.setdefault(local_name(e.tag), e)
        out = []
        for field in self.schema.fields:
            if field.name.startswith("@"):
                found = next((v for k, v in element.attrib.items() if local_name(k) == field.name[1:]), None)
                out.append(_value(found, field.dataType))
                continue
            e = by_name.get(field.name)
            if isinstance(field.dataType, ArrayType):
                rings = gml_rings(e) if e is not None else None
                out.append(rings or None)
            else:
                out.append(None if e is None else _value(e.text, field.dataType if not isinstance(field.dataType, StringType) else StringType()))
        return tuple(out)


class ArchiveSource(DataSource):
    """``spark.read.format("archive")`` with options rowTag, members (a pattern of names in archives) and a schema; fields are named as elements, @name as attributes, arrays of rings hold geometries."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        raise ValueError("an archive is read with a schema")

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, {k.lower(): v for k, v in self.options.items()})


def archived_xml(spark: SparkSession, path: str, row_tag: str, schema: str, members: str = "*.xml") -> DataFrame:
    """The ``row_tag`` elements of XML or GML files in zip archives (.zip), gzip files (.gz) or plain files, under a path or in one file."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").schema(schema).option("rowTag", row_tag).option("members", members).load(path)


def described(names: DataFrame, register: str) -> DataFrame:
    """name, entity, total, serial, day, time, format of a register's files by their names; names of another form are left out. zip holds XML, gz lines of JSON."""
    form = rf"(?i)^ois_{re.escape(register)}_(co[0-9]+t)_(na|da|te)000_([0-9]+)_([0-9]+)_([0-9]+)\.(zip|gz)$"
    part = lambda k: F.regexp_extract("name", form, k)
    return names.where(F.col("name").rlike(form)).select("name", F.lower(part(1)).alias("entity"), (F.lower(part(2)) != "da").alias("total"), part(3).cast("long").alias("serial"), part(4).alias("day"), part(5).alias("time"), F.when(F.lower(part(6)) == "zip", "xml").otherwise("ndjson").alias("format"))


def to_import(described_files: DataFrame, imported: int) -> DataFrame:
    """The files of one entity still to import, by serial: from the last total file on, or those after the last imported one. A serial that comes twice or is missing is an error.

    Works on a list of files, of which there are few for one entity.
    """
    if not described_files.groupBy("serial").count().where("count > 1").isEmpty():
        raise ValueError("two files have the same serial")
    total = described_files.where("total").agg(F.max("serial")).first()[0]
    first = max(imported + 1, total or 0)
    left = described_files.where(F.col("serial") >= first)
    seen = left.agg(F.min("serial"), F.max("serial"), F.count("*")).first()
    if seen[2] and (seen[0] != first or seen[1] - seen[0] + 1 != seen[2]):
        raise ValueError(f"a serial from {first} on is missing")
    return left.orderBy("serial")


def register_rows(spark: SparkSession, folder: str, files: DataFrame, row_tag: str, schema: str) -> DataFrame:
    """The rows of described files: XML from archives, JSON lines from gzip files, by what their names say; ``serial`` tells the files apart."""
    out = None
    for f in files.select("name", "serial", "format").collect():  # the files of one import
        path = f"{folder.rstrip('/')}/{f.name}"
        rows = archived_xml(spark, path, row_tag, schema) if f.format == "xml" else spark.read.json(path, schema=schema, mode="FAILFAST")
        rows = rows.withColumn("serial", F.lit(f.serial).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"{schema}, serial long")
