"""Durable ledgers: table snapshots under numbered versions and one manifest for each commit.

A commit writes the tables that changed into a folder of its own and then
renames one manifest into place, which names the folder of every table. The
rename is the commit: before it nothing is visible, and of two commits on the
same version one finds the name taken and fails. Readers pin a manifest.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.operators.ledger import Ledger, new_ledger
from tidemill.schema import SCHEMA_VERSION, TABLES

# Tables whose readers mostly want one value of a column.
PARTITIONED = {"items": ["state"], "item_history": ["day"]}


class Conflict(RuntimeError):
    """Another commit took the version."""


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into spark.checkpoint.dir; a folder is made up only where a local session has none."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tidemill-ledger-"))
    return df.checkpoint(eager=True)


class LedgerStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest-{version:012d}.json"

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def load(self, version: int | None = None) -> tuple[Ledger, int]:
        """The ledger of a version (the latest by default) and its number; version 0 is empty."""
        have = self.versions()
        version = version if version is not None else (have[-1] if have else 0)
        if not version:
            return new_ledger(self.spark), 0
        m = self._read(version)
        if m["schema"] != SCHEMA_VERSION:
            raise ValueError(f"the ledger has schema {m['schema']}, this library {SCHEMA_VERSION}; migrate it first")
        fresh = new_ledger(self.spark)
        frames = {t: self.spark.read.schema(TABLES[t]).parquet(f"{self.root}/{at}/{t}") if at else fresh.frames[t] for t, at in m["tables"].items()}
        return Ledger(frames, m["next_item"], m["next_attempt"], frames), version

    def commit(self, base: Ledger, version: int, new: Ledger, before_rename: Callable[[], None] | None = None) -> int:
        """Writes what ``new`` changed in ``base`` (of ``version``) as the next version; without a change ``version`` stays."""
        if all(f is base.frames[t] for t, f in new.frames.items()) and (new.next_item, new.next_attempt) == (base.next_item, base.next_attempt):
            return version
        if self.versions()[-1:] > [version]:
            raise Conflict(f"version {version} is not the latest")
        at = f"v={version + 1}-{uuid.uuid4().hex[:8]}"
        old = self._read(version)["tables"] if version else dict.fromkeys(TABLES)
        tables = {}
        for t, frame in new.frames.items():
            if frame is base.frames[t]:
                tables[t] = old[t]
                continue
            frame.write.partitionBy(*PARTITIONED.get(t, [])).parquet(f"{self.root}/{at}/{t}")
            tables[t] = at
        self._publish(version + 1, {"schema": SCHEMA_VERSION, "tables": tables, "next_item": new.next_item, "next_attempt": new.next_attempt}, at, before_rename)
        return version + 1

    def _publish(self, version: int, manifest: dict, at: str, before_rename: Callable[[], None] | None = None) -> None:
        """Makes a manifest visible under its version, or fails if that is taken."""
        body = json.dumps(manifest)
        draft = self._path(f"{self.root}/{at}/manifest")
        out = self._fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        if before_rename:
            before_rename()
        target = self._path(self._manifest(version))
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise Conflict(f"version {version} was taken")

    def apply(self, change: Callable[[Ledger], object]) -> object:
        """Runs a transition on the latest version and commits it; returns what it returned besides the ledger."""
        base, version = self.load()
        out = change(base)
        new, *rest = out if isinstance(out, tuple) else (out,)
        self.commit(base, version, new)
        return rest[0] if len(rest) == 1 else tuple(rest)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the last ``keep`` versions names; returns how many."""
        have = self.versions()
        used = {at for v in have[-keep:] for at in self._read(v)["tables"].values() if at}
        gone = 0
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if name.startswith("v=") and name not in used:
                gone += bool(self._fs.delete(s.getPath(), True))
        for v in have[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        return gone


# Tables that each version of the schema brought.
MIGRATIONS = [
    (1, "ledger tables", ["queues", "items", "executions", "steps", "attempts"]),
    (2, "step edges", ["step_edges"]),
    (3, "folded counts, hourly tally and history", ["step_counts", "done_hourly", "item_history"]),
]


def migrations() -> list[tuple[int, str]]:
    """Versions of the schema and what each brought."""
    return [(v, what) for v, what, _ in MIGRATIONS]


def migrate(store: LedgerStore, to: int = SCHEMA_VERSION) -> tuple[int, int]:
    """Brings a ledger to another version of the schema in one manifest; returns the versions before and after.

    Going up adds empty tables; going down forgets what later versions
    brought, whose files go with the next vacuum. Migrating is never done on
    its own: opening a ledger of another version fails.
    """
    if not 0 < to <= SCHEMA_VERSION:
        raise ValueError(f"there is no version {to} of the schema")
    have = store.versions()
    if not have:
        return to, to
    m = store._read(have[-1])
    known = {t for v, _, tables in MIGRATIONS if v <= to for t in tables}
    if m["schema"] != to:
        store._publish(have[-1] + 1, m | {"schema": to, "tables": {t: m["tables"].get(t) for t in TABLES if t in known}}, f"v={have[-1] + 1}-migrated")
    return m["schema"], to


def import_jdbc(spark: SparkSession, url: str, tables: dict[str, str], properties: dict[str, str] | None = None, partitions: int = 16, bounds: tuple[int, int] | None = None) -> Ledger:
    """A ledger from tables of a database: ledger table -> table or query there, read in ranges of the id where bounds are given."""
    ledger = new_ledger(spark)
    frames = dict(ledger.frames)
    for t, source in tables.items():
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).options(**(properties or {}))
        if bounds and "id bigint" in TABLES[t]:
            reader = reader.option("partitionColumn", "id").option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
        frames[t] = reader.load().to(spark.createDataFrame([], TABLES[t]).schema)
    last = lambda t: (frames[t].agg({"id": "max"}).first()[0] or 0) + 1
    return Ledger(frames, last("items"), last("attempts"))
