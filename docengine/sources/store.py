"""Tables that change by commits: Parquet folders and a small file for each version that names them.

A table is cut into parts by a hash of its key.  A change writes new folders for the parts that it touches and then publishes the next
version, which names them beside the untouched ones.  Publishing is one rename that fails if the version is there already: readers see
all of a change or nothing, a job that fails half way leaves the table as it was, and of two writers from one version one is refused.
Everything goes through Spark and Hadoop's file system, so that the folder can be in any store that the cluster shares.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.operators import documents as D


class Conflict(RuntimeError):
    """Another writer has published the version that this one was going to."""


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share, under ``spark.checkpoint.dir``; a local session may do without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/docengine-{spark.sparkContext.applicationId}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = getattr(spark, "_docengine_tables", None)
    if made is None:
        made = spark._docengine_tables = "file://" + tempfile.mkdtemp(prefix="docengine-")
    return f"{made}/{name}"


def scratch_table(rows: DataFrame, name: str) -> DataFrame:
    """Write rows into a new shared folder and read them back: cuts lineage and survives lost executors."""
    path = shared_folder(rows.sparkSession, f"{name}-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Versions:
    """The versions of a folder: each names the data folders of every part, and holds a few small facts about the whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return sorted(f.getPath().getName() for f in self._files().listStatus(at)) if self._files().exists(at) else []

    def latest(self) -> int:
        """The number of the last version; 0 if there is none."""
        return max((int(n[:-5]) for n in self._names("versions") if n.endswith(".json")), default=0)

    def load(self, version: int | None = None) -> dict:
        """``parts`` (name -> folders), ``schemas`` (table -> DDL as JSON) and ``facts`` of a version, by default the last."""
        number = self.latest() if version is None else version
        if not number:
            return {"version": 0, "parts": {}, "schemas": {}, "facts": {}}
        stream = self._files().open(self._at("versions", f"{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": number}

    def write(self, table: str, rows: DataFrame, part: Column) -> dict[str, list[str]]:
        """Write rows into new folders by part (a number); returns name -> folders.  Nothing reads them before a commit."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        return {f"{table}/{n[6:]}": [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("_part=")}

    def discard(self, made: dict[str, list[str]]) -> None:
        """Delete folders that ``write`` made and no version names."""
        for folder in {f.split("/")[1] for fs in made.values() for f in fs}:
            self._files().delete(self._at("data", folder), True)

    def commit(self, base: dict, parts: dict[str, list[str]], schemas: dict[str, str] | None = None, facts: dict | None = None) -> int:
        """Publish the version after ``base`` with these parts in place of its own; an empty list takes a part away."""
        new = {k: v for k, v in (base["parts"] | parts).items() if v}
        body = json.dumps({"parts": new, "schemas": base["schemas"] | (schemas or {}), "facts": base["facts"] | (facts or {})})
        made, target = self._at("versions", f"{uuid.uuid4().hex}.new"), self._at("versions", f"{base['version'] + 1:012d}.json")
        out = self._files().create(made, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._files().getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(made, target, plain)  # refuses to replace a file
        except Exception as e:
            self._files().delete(made, False)
            if "exist" in str(e).lower():
                raise Conflict(f"version {base['version'] + 1} is there already") from None
            raise
        return base["version"] + 1

    def read(self, state: dict, table: str, keep: Callable[[int], bool] = lambda _: True) -> DataFrame:
        """The rows of a table's parts whose number ``keep`` accepts; folders of other parts aren't even listed."""
        schema = T.StructType.fromJson(json.loads(state["schemas"][table]))
        head = f"{table}/"
        folders = [f"{self.path}/{f}" for name, fs in state["parts"].items() if name.startswith(head) and keep(int(name[len(head) :])) for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def vacuum(self, versions: int = 2) -> int:
        """Delete all but the last versions and the data folders that none of them names; returns how many folders went."""
        last, went = self.latest(), 0
        kept = [n for n in range(max(1, last - versions + 1), last + 1)]
        named = {f.split("/")[1] for n in kept for fs in self.load(n)["parts"].values() for f in fs}
        for name in self._names("versions"):
            if name.endswith(".json") and int(name[:-5]) not in kept:
                self._files().delete(self._at("versions", name), False)
        for name in self._names("data"):
            if name not in named:
                self._files().delete(self._at("data", name), True)
                went += 1
        return went


class KeptTable:
    """A table under a key, in parts by its hash.  Every change is one commit and rewrites the touched parts only.

    A key may have many rows (the chunks of a source).  Rows with a null key are kept, and changes by key never meet them.  Columns
    of changes are matched by name.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.versions, self.key, self.spark = Versions(spark, path), key, spark

    @classmethod
    def create(cls, path: str, rows: DataFrame, key: str, parts: int = 32) -> KeptTable:
        """Write the first version."""
        t = cls(rows.sparkSession, path, key)
        t._publish(t.versions.load(), rows, parts, None, {"rows": json.dumps(rows.schema.jsonValue())}, {"parts": parts})
        return t

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(parts)).cast("int")

    def _publish(self, base: dict, rows: DataFrame, parts: int, touched: list[int] | None, schemas: dict | None = None, facts: dict | None = None) -> int:
        part = self._part(parts)
        new = self.versions.write("rows", rows.repartition(part), part)
        gone = {f"rows/{p}": [] for p in touched or []}
        return self.versions.commit(base, gone | new, schemas, facts)

    def read(self, version: int | None = None) -> DataFrame:
        return self.versions.read(self.versions.load(version), "rows")

    def _change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Commit ``change`` of the rows in the parts that the keys fall into (at most as many numbers as there are parts)."""
        base = self.versions.load()
        n = base["facts"]["parts"]
        touched = sorted(r[0] for r in keys.select(self._part(n)).distinct().collect())
        if not touched:
            return base["version"]
        held = self.versions.read(base, "rows", set(touched).__contains__)
        return self._publish(base, change(held), n, touched)

    def append(self, new: DataFrame) -> int:
        """Add rows; parts get further files and nothing is rewritten."""
        base = self.versions.load()
        cols = json.loads(base["schemas"]["rows"])["fields"]
        part = self._part(base["facts"]["parts"])
        made = self.versions.write("rows", new.select(*[F.col(f"`{c['name']}`") for c in cols]).repartition(part), part)
        return self.versions.commit(base, {p: base["parts"].get(p, []) + fs for p, fs in made.items()})

    def replace(self, new: DataFrame) -> int:
        """The rows of each key in ``new`` give way to its rows."""
        return self._change(new, lambda held: D.replace_rows(held, new, self.key))

    def delete(self, keys: DataFrame) -> int:
        return self._change(keys, lambda held: D.delete_cascade(keys, self.key, held)[0])

    def update(self, patch: DataFrame) -> int:
        """Columns of the patch that are not null replace those of the rows with its key."""
        return self._change(patch, lambda held: D.partial_update(held, patch, self.key))

    def upsert(self, new: DataFrame) -> int:
        """One row per key: those of ``new`` replace or join the others."""
        return self._change(new, lambda held: D.upsert_meta(held, new, self.key))

    def delete_where(self, condition: Column) -> int:
        """Delete by a condition; parts without such a row stay as they are.  A null condition keeps the row."""
        doomed = F.coalesce(condition, F.lit(False))
        return self._change(self.read().where(doomed), lambda held: held.where(~doomed))

    def update_where(self, condition: Column, **values: Column) -> int:
        """Set columns where a condition holds; parts without such a row stay as they are."""
        hit = F.coalesce(condition, F.lit(False))
        return self._change(self.read().where(hit), lambda held: held.select(*[F.when(hit, values[c]).otherwise(F.col(f"`{c}`")).cast(held.schema[c].dataType).alias(c) if c in values else F.col(f"`{c}`") for c in held.columns]))
