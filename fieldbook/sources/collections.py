"""GeoJSON collections as a sink: every file is a whole FeatureCollection with its coordinate system and box; the box of all is written last.

Tasks write under the folder's ``_writing`` and say what they wrote; only then does the commit move the files to their place and
write ``_collection.json``. A task or job that fails leaves no file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fieldbook.operators.shapes import DEPTH
from fieldbook.sources.archives import _files

CRS = "EPSG:25832"


def without_heights(coordinates: Column, depth: int) -> Column:
    """Coordinates of a depth of nesting without heights; points of lines that repeat the one before go."""
    if depth == 0:
        return F.slice(coordinates, 1, 2)
    inner = F.transform(coordinates, lambda c: without_heights(c, depth - 1))
    return inner if depth > 1 else F.filter(inner, lambda p, i: (i == 0) | (p != F.get(inner, i - 1)))


def box(coordinates: Column, depth: int) -> Column:
    """[x0, y0, x1, y1] of coordinates, null without any."""
    points = F.array(coordinates) if depth == 0 else coordinates
    for _ in range(max(depth - 1, 0)):
        points = F.flatten(points)
    of = lambda k, f: f(F.transform(points, lambda p: p[k]))
    return F.when(F.size(points) > 0, F.array(of(0, F.array_min), of(1, F.array_min), of(0, F.array_max), of(1, F.array_max)))


def features(df: DataFrame, kind: str, coordinates: str, properties: list[str], heights: bool = False) -> DataFrame:
    """feature (JSON text), bbox: what the sink writes. Null coordinates give a null geometry and no box."""
    depth = DEPTH[kind]
    c = F.col(coordinates) if heights else F.when(F.col(coordinates).isNotNull(), without_heights(F.col(coordinates), depth))
    geometry = F.when(c.isNotNull(), F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})
    return df.select(feature.alias("feature"), box(c, depth).alias("bbox"))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    count: int
    box: list[float] | None


def _joined(boxes: list[list[float]]) -> list[float] | None:
    if not boxes:
        return None
    x0, y0, x1, y1 = zip(*boxes, strict=True)
    return [min(x0), min(y0), max(x1), max(y1)]


class CollectionWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.crs, self.most = options["path"], options.get("crs", CRS), int(options.get("mostfeatures", 100_000))
        self.job = uuid.uuid4().hex
        self.form, self.callback = options.get("form", "features"), options.get("callback", "")
        # made on the driver only: a task that outlives an aborted job finds no folder to write to
        system, root = _root(self.path)
        system.create_dir(f"{root}/_writing/{self.job}", recursive=True)

    def around(self, box: list[float] | None) -> tuple[str, str]:
        """What stands before and after the rows of a file."""
        if self.form == "features":
            head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": self.crs}}, "bbox": box}
            return json.dumps(head)[:-1] + ', "features": [\n', "\n]}\n"
        return (f"{self.callback}([", "]);\n") if self.callback else ("[\n", "\n]\n")

    def write(self, iterator: Iterator) -> Written:
        system, root = _root(self.path)
        folder = f"{root}/_writing/{self.job}"
        files, boxes, count, rows = [], [], 0, []

        def flush() -> None:
            name = f"{folder}/part-{uuid.uuid4().hex}.json"
            own = [r[1] for r in rows if r[1] is not None]
            head, tail = self.around(_joined(own))
            with system.open_output_stream(name) as f:
                f.write(head.encode())
                for k, (feature, _) in enumerate(rows):
                    f.write(((",\n" if k else "") + feature).encode())
                f.write(tail.encode())
            files.append(name)
            boxes.extend([_joined(own)] if own else [])
            rows.clear()

        for row in iterator:
            rows.append((row["feature"], row["bbox"]))
            count += 1
            if len(rows) >= self.most:
                flush()
        if rows:
            flush()
        return Written(files, count, _joined(boxes))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _root(self.path)
        told = [m for m in messages if m is not None]
        for name in (f for m in told for f in m.files):
            system.move(name, f"{root}/{name.rpartition('/')[2]}")
        system.delete_dir(f"{root}/_writing")
        if self.form != "features":
            return
        whole = {"crs": self.crs, "bbox": _joined([m.box for m in told if m.box]), "features": sum(m.count for m in told)}
        with system.open_output_stream(f"{root}/_collection.json") as f:
            f.write(json.dumps(whole).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _root(self.path)
        from pyarrow import fs

        if system.get_file_info(f"{root}/_writing").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_writing")


def _root(path: str):
    system, _ = _files(path)
    return system, path.split("://", 1)[1] if "://" in path else path.removeprefix("file:")


class CollectionSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        return CollectionWriter({k.lower(): v for k, v in self.options.items()})


def write_collection(made: DataFrame, path: str, crs: str = CRS, most: int = 100_000) -> None:
    """Features of ``features`` to a folder of collections of at most so many features a file."""
    made.sparkSession.dataSource.register(CollectionSink)
    made.write.format("feature_collection").mode("append").option("crs", crs).option("mostFeatures", most).save(path)


def write_json(df: DataFrame, path: str, pretty: bool = False, callback: str | None = None, most: int = 100_000) -> None:
    """Rows as files of one JSON array each, nulls included; ``pretty`` over several lines, with ``callback`` as a call of that function."""
    if callback is not None and not callback.replace(".", "_").isidentifier():
        raise ValueError(f"{callback} is no name of a function")
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    df.sparkSession.dataSource.register(CollectionSink)
    rows = df.select(text.alias("feature"), F.lit(None).cast("array<double>").alias("bbox"))
    rows.write.format("feature_collection").mode("append").option("form", "rows").option("callback", callback or "").option("mostFeatures", most).save(path)
