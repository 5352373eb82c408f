"""Tables whose parts are replaced whole, in two phases.

A part is what a key names: a day, a team, a model.  New rows are staged as
a version of their own, checked where they lie, and become readable by one
commit mark: a small file that names the version and the parts it replaces.
A write that fails, or fails its check, leaves every part as it was; writers
of different parts do not disturb each other, first writers included; of two
writers of one part the later mark counts.  Nothing in the session is
switched.

    <path>/data/version=<id>/<key>=<value>/...     rows
    <path>/marks/<number>-<id>.json                commit marks

Marks appear by a rename, so a reader sees all of a version or nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Versions:
    """A table below ``path`` whose rows ``schema`` (DDL) describes, replaced part by part of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, StructType.fromDDL(schema)

    # -- files -----------------------------------------------------------
    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        fs, at = self._file(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def marks(self) -> list[dict]:
        """Commit marks, oldest first: ``{"version", "parts": {part: rows}}``; a null part is ``None``."""
        out = []
        for name in self._names("marks"):
            if name.endswith(".json") and not name.startswith((".", "_")):
                fs, at = self._file(f"marks/{name}")
                stream = fs.open(at)
                try:
                    mark = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
                out.append({"number": int(name.split("-")[0]), "version": mark["version"], "parts": {k: n for k, n in mark["parts"]}})
        return out

    def live(self) -> dict[str | None, tuple[str, int]]:
        """``{part: (version, rows)}`` as the marks have it."""
        return {part: (m["version"], n) for m in self.marks() for part, n in m["parts"].items()}

    # -- writing -----------------------------------------------------------
    def replace(self, rows: DataFrame, parts: Sequence[str | None], check: Callable[[DataFrame], None] | None = None) -> dict:
        """Replaces the named parts by ``rows``: a named part without a row is
        empty from then on.  ``check`` gets the staged rows and raises to refuse them; rows
        of a part that is not named are refused too.  Returns the mark."""
        version = uuid.uuid4().hex
        place = f"{self.path}/data/version={version}"
        fs, at = self._file(f"data/version={version}")
        text = F.col(self.key).cast("string")
        try:
            columns = [F.col(c) for c in self.schema.names if c != self.key]
            # files of a part: as many as its size needs
            dealt = rows.select(text.alias("__part"), F.col(self.key), *columns).hint("rebalance", "__part")
            dealt.write.partitionBy("__part").parquet(place)
            staged = self._read(version)
            counts = {r["__part"]: r["n"] for r in staged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
            if unknown := counts.keys() - set(parts):
                raise ValueError(f"rows of parts that are not replaced: {sorted(map(str, unknown))}")
            if check is not None:
                check(staged.select(*self.schema.names))
        except BaseException:
            fs.delete(at, True)
            raise
        return self._commit(version, {p: counts.get(p, 0) for p in parts})

    def _commit(self, version: str, parts: dict) -> dict:
        number = max((int(n.split("-")[0]) for n in self._names("marks") if n.endswith(".json") and n[0].isdigit()), default=0) + 1
        fs, draft = self._file(f"marks/.{version}.tmp")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps({"version": version, "parts": list(parts.items())}).encode()))
        finally:
            stream.close()
        name = f"{number:012d}-{version}.json"
        if not fs.rename(draft, self._file(f"marks/{name}")[1]):
            raise OSError(f"the commit mark {name} could not be written")
        return {"number": number, "version": version, "parts": parts}

    # -- reading -----------------------------------------------------------
    def _read(self, version: str, parts: Sequence | None = None) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("__part", "string")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data/version={version}")
        if parts is None:
            return rows
        kept = [p for p in parts if p is not None]
        some = F.col("__part").isin(kept) if kept else F.lit(False)
        return rows.where(some | F.col("__part").isNull() if None in parts else some)

    def read(self, parts: Sequence | None = None) -> DataFrame:
        """The rows of all parts, or of the named ones: only their files are read."""
        by: dict[str, list] = {}
        for part, (version, n) in self.live().items():
            if n and (parts is None or part in parts):
                by.setdefault(version, []).append(part)
        out = self.spark.createDataFrame([], self.schema)
        for version, own in sorted(by.items()):
            out = out.unionByName(self._read(version, own).select(*self.schema.names))
        return out

    def vacuum(self) -> int:
        """Deletes staged and replaced versions that no mark needs; not while others write or
        read.  Returns how many went."""
        needed = {v for v, n in self.live().values() if n}
        gone = [n for n in self._names("data") if n.startswith("version=") and n.split("=", 1)[1] not in needed]
        for name in gone:
            fs, at = self._file(f"data/{name}")
            fs.delete(at, True)
        return len(gone)
