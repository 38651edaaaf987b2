"""Stored measurement documents as a data source: nested JSON, one folder a day, searched by pushed filters.

A search is a filter and a list of fields.  The filters go to the reader: those on the time choose the days whose files are
read at all; all others are tested on whole columns before a row leaves the reader.  Only the asked fields are parsed.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "stored_documents"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"

COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
TEXT = {StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}


def write_documents(df: DataFrame, document: Column, time: Column, path: str, per_file: int = 200_000) -> None:
    """Writes one JSON document a row, in folders by the day of `time`, a timestamp without zone (rows without time have a folder of their own)."""
    rows = df.select(F.date_format(time, "yyyy-MM-dd").alias("day"), document.alias("document")).select("day", "document.*")
    rows.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("maxRecordsPerFile", per_file).partitionBy("day").json(path)


def search(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]], where: Column | str = "true", time: str | None = None) -> DataFrame:
    """`fields`, {column: (path with dots, type)}, of the documents for which `where` is true; absent fields are null.

    `time` names the column whose day the folders are for.  A document store that is filtered in another way is another search.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredDocuments)
    ddl = ", ".join(f"`{name}` {kind}" for name, (_, kind) in fields.items())
    places = json.dumps({name: at for name, (at, _) in fields.items()})
    reader = spark.read.format(FORMAT).schema(ddl).option("places", places)
    found = (reader.option("time", time) if time else reader).load(path).where(where)
    # One loaded source remembers the last filters pushed to it, for all frames made of it: no later filter may reach it.
    return found.mapInArrow(_unchanged, found.schema)


class StoredDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(schema, self.options["path"], json.loads(self.options["places"]), self.options.get("time"))


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class DocumentReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, paths: dict[str, str], time: str | None):
        self.schema, self.path, self.paths, self.time = schema, path, paths, time
        self.filters: list[Filter] = []
        self.first, self.last = datetime.date.min, datetime.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what it can decide as Spark would, and gives back the rest.  Time filters also narrow the days."""
        for f in filters:
            if self._known(f):
                self.filters.append(f)
                self._narrow(f)
            else:
                yield f

    @staticmethod
    def _known(f: Filter) -> bool:
        inner = f.child if isinstance(f, Not) else f
        if len(getattr(inner, "attribute", ())) != 1:
            return False
        if isinstance(inner, In):
            return None not in inner.value
        return isinstance(inner, (*COMPARE, *TEXT, IsNull, IsNotNull))

    def _narrow(self, f: Filter) -> None:
        if isinstance(f, Not) or f.attribute != (self.time,) or not isinstance(getattr(f, "value", None), datetime.datetime) or f.value.tzinfo:
            return
        day = f.value.date()
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.first = max(self.first, day)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            # Before midnight is the day before.
            before = f.value - datetime.timedelta(microseconds=1) if isinstance(f, LessThan) else f.value
            self.last = min(self.last, before.date())

    def partitions(self) -> Sequence[InputPartition]:
        """The files of the days that are left; a file without a day is read unless the time is bounded."""
        store, root = _store(self.path)
        bounded = (self.first, self.last) != (datetime.date.min, datetime.date.max)
        out = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path.rpartition("/")[2]
            if not info.is_file or name.startswith(("_", ".")) or not info.size:
                continue
            day = re.search(r"/day=([^/]+)/", info.path)
            if day and day[1] != NO_DAY:
                if not self.first <= datetime.date.fromisoformat(day[1]) <= self.last:
                    continue
            elif bounded and day:
                continue
            out.append(File(info.path))
        # A reader without partitions would be called once with None.
        return sorted(out, key=lambda p: p.path) or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        target = to_arrow_schema(self.schema)
        wanted: dict = {}
        for f in target:
            at = wanted
            *above, leaf = self.paths[f.name].split(".")
            for part in above:
                at = at.setdefault(part, {})
            at[leaf] = pa.timestamp("us") if pa.types.is_timestamp(f.type) else f.type
        options = pa.json.ParseOptions(explicit_schema=pa.schema(_fields(wanted)), unexpected_field_behavior="ignore")
        store, _ = _store(self.path)
        with store.open_input_stream(partition.path) as lines:
            table = pa.json.read_json(lines, parse_options=options)
        columns = [pc.struct_field(table[head], rest) if rest else table[head] for head, *rest in (self.paths[n].split(".") for n in target.names)]
        table = pa.table([c.cast(f.type) for c, f in zip(columns, target)], schema=target)
        for f in self.filters:
            table = table.filter(_test(table, f))
        yield from table.to_batches(max_chunksize=10_000)


def _unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batches


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def _fields(tree: dict) -> list[pa.Field]:
    return [pa.field(name, pa.struct(_fields(kind)) if isinstance(kind, dict) else kind) for name, kind in tree.items()]


def _test(table: pa.Table, f: Filter) -> pa.ChunkedArray:
    """True, false or null for each row, null where the value is."""
    if isinstance(f, Not):
        return pc.invert(_test(table, f.child))
    column = table[f.attribute[0]]
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.if_else(pc.is_valid(column), pc.is_in(column, pa.array(list(f.value), column.type)), None)
    if type(f) in TEXT:
        return TEXT[type(f)](column, f.value)
    return COMPARE[type(f)](column, pa.scalar(f.value, column.type))
