"""SQLite databases, zip packs, embedded and strict JSON, layered settings."""

from __future__ import annotations

import io
import json
import sqlite3
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(low)
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", "4"))

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition):
        with self._connect() as db:
            have = {r[1].lower() for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            # Columns that an older writer left out are read as nulls.
            wanted = ", ".join(f'"{f.name}"' if f.name.lower() in have else f'NULL AS "{f.name}"' for f in self.schema)
            yield from db.execute(f'SELECT {wanted} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table").schema(...).option("path", ...).option("table", ...)``.

    The file must be a finished copy that every executor can open.  Ranges of
    row numbers are read by different tasks.
    """

    @classmethod
    def name(cls):
        return "sqlite_table"

    def reader(self, schema: StructType):
        return _SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    if not table.replace("_", "").isalnum():
        raise ValueError("a table's name has letters, digits and underscores only")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).option("partitions", str(partitions)).load()


def read_zip_members(spark: SparkSession, path: str, members: list[str], pattern: str = "*.zip") -> DataFrame:
    """The named text members of zip packs: path, member, text, problem (``missing`` or ``corrupt``)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def scan(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    pack = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    rows += [(name, m, None, "corrupt") for m in members]
                    continue
                for m in members:
                    try:
                        rows.append((name, m, pack.read(m).decode("utf-8"), None))
                    except KeyError:
                        rows.append((name, m, None, "missing"))
                    except (zipfile.BadZipFile, UnicodeDecodeError):
                        rows.append((name, m, None, "corrupt"))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "member", "text", "problem"])

    return files.mapInArrow(scan, "path string, member string, text string, problem string")


def embedded_json(page: Column, name: str) -> Column:
    """The object that a page's script assigns to ``name``, as JSON text; bare ``undefined`` becomes null."""
    raw = F.regexp_extract(page, rf"(?s){name}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    return F.nullif(F.regexp_replace(raw, r":\s*undefined\b", ": null"), F.lit(""))


def strict_object(text: str) -> dict:
    """A JSON object; repeated keys and other values are errors."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ValueError("a key stands twice")
        return dict(items)

    value = json.loads(text, object_pairs_hook=pairs)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return value


def effective_settings(layers: DataFrame) -> DataFrame:
    """The value of each key from the layer with the highest rank that states one: key, value, source.

    ``layers``: rank, source, key, value; null and empty values state nothing.
    """
    rows = layers.where("key is not null and value is not null and value <> ''")
    return rows.groupBy("key").agg(F.max(F.struct("rank", "source", "value")).alias("m")).select("key", "m.value", "m.source")


def response_class(status: Column, code: Column) -> Column:
    """What to do after a reply: ok, retry or error."""
    return F.when((status == 429) | (status >= 500), "retry").when((status >= 200) & (status < 300) & (F.coalesce(code, F.lit(0)) == 0), "ok").otherwise("error")
