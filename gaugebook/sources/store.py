"""The table set: Parquet folders that a commit lists by name.

A write goes to a folder of its own, `<root>/<table>/attempt=<unique>/epoch=N/...`,
so that a crashed or slow writer never touches the files of another. A commit is
one JSON file, `<root>/commits/<N>.json`, that lists for every table the folders that
belong to it. It is created whole and only if it does not exist (`commits`): of two writers that started
from the same head one commits and the other gets `CommitConflict`, and starts
again from the new head. Readers open the newest commit and exactly the folders in
it, so nothing uncommitted is ever visible, whatever is committed later.

Tables that are looked up by key lie in buckets by the hash of the key (`bucket=K` below
`epoch=N`). A commit keeps, for each folder, the buckets it holds and the range of its
keys; a lookup with the `Keys` of an epoch opens only folders that may hold them, and its
bucket filter prunes the rest. Snapshots (`SNAPSHOTS`) are written bucket by bucket: a
commit replaces the buckets it has written and goes on listing the others where they are.

Ids that follow from other columns of their row (`DERIVED`) are not written: readers work
them out again. Only one that differs is kept, so every row is read as it was written.
A folder may belong to two tables: new events are written once, into the pending ones, and
`events_out` lists that folder by its table and name.

`compact` rewrites a table that has gathered many folders as one; `vacuum` removes
folders that the newest commit does not list.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugebook.functions.values import derived_uuid, or_else, unless
from gaugebook.schemas import BUCKETED_BY, PARTITIONED_BY, TABLES
from gaugebook.sources.commits import CommitFiles

#: Tables of which a write replaces the buckets it names.
SNAPSHOTS = frozenset({"site_summary", "events_pending"})
#: Buckets of a new store; more of them for larger ones. A store keeps its number.
BUCKETS = 32
NUMBERED = re.compile(r"\d+\.json")


def _batch_id() -> Column:
    return derived_uuid(F.col("site_id"), F.col("idempotency_key"))


#: Columns (or fields of one) that the files leave out where they equal this, in order of reading.
DERIVED: dict[str, list[tuple[str, Callable[[], Column]]]] = {
    "measurements": [("id", lambda: derived_uuid(F.col("batch_id"), F.col("arrival_ord")))],
    "batch_ledger": [
        ("id", _batch_id),
        ("response.batch_id", lambda: F.col("id")),
        ("response.site_id", lambda: F.col("site_id")),
    ],
    "ingest_results": [("batch_id", _batch_id)],
}


def _changed(df: DataFrame, name: str, value: Column) -> DataFrame:
    column, _, field_ = name.partition(".")
    return df.withColumn(column, F.col(column).withField(field_, value) if field_ else value)


def without_derived(df: DataFrame, table: str) -> DataFrame:
    for name, derived in reversed(DERIVED.get(table, [])):
        df = _changed(df, name, unless(F.col(name), derived()))
    return df


def with_derived(df: DataFrame, table: str) -> DataFrame:
    for name, derived in DERIVED.get(table, []):
        df = _changed(df, name, or_else(F.col(name), derived()))
    return df


class CommitConflict(Exception):
    """Another writer has committed this epoch."""


@dataclass(frozen=True)
class Head:
    """The newest commit. `streams` maps a stream to its last applied batch, `folders`
    a table to its attempt folders."""

    epoch: int = 0
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    #: Per folder of a bucketed table: `buckets` that count, `written` ones, `low` and `high` key.
    holds: dict[str, dict] = field(default_factory=dict)
    buckets: int | None = None
    #: The number of the next commit.
    following: int = 1

    @property
    def tables(self) -> frozenset[str]:
        return frozenset(t for t, folders in self.folders.items() if folders)


@dataclass(frozen=True)
class Keys:
    """Where the keys of an epoch lie in a table: their buckets, and the range of their texts."""

    buckets: tuple[int, ...]
    low: str | None = None
    high: str | None = None

    def may_be_in(self, holds: dict) -> bool:
        if not set(self.buckets) & set(holds["buckets"]):
            return False
        if self.low is None or holds["low"] is None:
            return True
        return holds["low"] <= self.high and self.low <= holds["high"]


@dataclass(frozen=True)
class Written:
    """A folder that waits for its commit. `replaces`: the buckets of its table it stands for."""

    table: str
    folder: str
    holds: dict | None = None
    replaces: tuple[int, ...] = ()

    def also_for(self, table: str) -> Written:
        """The folder listed for another table too, which reads some of its columns."""
        return Written(table, f"{self.table}/{self.folder}")


def key_text(table: str) -> Column | None:
    """The text that ranges of keys are kept of; numbers have none, since texts sort otherwise."""
    columns = BUCKETED_BY[table]
    return None if columns == ["id"] else F.concat_ws("/", *columns)


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.commits = CommitFiles(spark, f"{self.root}/commits")
        self._buckets = buckets

    # ---- files ---------------------------------------------------------------
    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    # ---- commits -------------------------------------------------------------
    def head(self) -> Head:
        """The newest commit. A file that is not whole (damaged, or left by a writer without
        atomic creation) is passed over, and its number is not used again."""
        following = 1
        for name in sorted((n for n in self.commits.names() if NUMBERED.fullmatch(n)), reverse=True):
            following = max(following, int(name.removesuffix(".json")) + 1)
            try:
                c = json.loads(self.commits.text(name))
            except json.JSONDecodeError:
                continue
            return Head(int(c["epoch"]), {t: tuple(f) for t, f in c["folders"].items()}, c["streams"],
                        c["holds"], c["buckets"], following)
        return Head(following=following)

    def commit(
        self,
        head: Head,
        wrote: list[Written],
        at: datetime,
        stream: tuple[str, int] | None = None,
        replaced: bool = False,
    ) -> int:
        """Make epoch `head.following` visible, or raise CommitConflict.

        With `replaced`, what was written stands for all earlier folders of its tables.
        """
        epoch = head.following
        folders, holds = dict(head.folders), dict(head.holds)
        for w in wrote:
            old = []
            for folder in () if replaced else folders.get(w.table, ()):
                if w.replaces and folder in holds:
                    left = [b for b in holds[folder]["buckets"] if b not in w.replaces]
                    holds[folder] = {**holds[folder], "buckets": left}
                    if not left:
                        continue
                old.append(folder)
            folders[w.table] = (*old, w.folder)
            if w.holds is not None:
                holds[w.folder] = w.holds
        listed = {folder for names in folders.values() for folder in names}
        text = json.dumps({
            "epoch": epoch,
            "folders": folders,
            "holds": {folder: h for folder, h in holds.items() if folder in listed},
            "buckets": self.buckets(head),
            "streams": {**head.streams, **({stream[0]: stream[1]} if stream else {})},
            "committed_at": at.isoformat(),
            "writer": uuid.uuid4().hex,  # tells two writers of the same rows apart
        })
        if not self.commits.create(f"{epoch:012d}.json", text):
            raise CommitConflict(f"epoch {epoch} is committed already")
        return epoch

    # ---- tables --------------------------------------------------------------
    def buckets(self, head: Head) -> int:
        return head.buckets or self._buckets

    def bucket_of(self, table: str, head: Head) -> Column:
        return F.pmod(F.xxhash64(*BUCKETED_BY[table]), F.lit(self.buckets(head))).cast("int")

    def keys(self, rows: DataFrame, table: str, head: Head) -> Keys:
        """Where the keys of `rows` (with the columns of BUCKETED_BY) lie. One aggregation; what
        comes to the driver is at most a number per bucket and two keys."""
        text = key_text(table)
        ends = [F.min(text), F.max(text)] if text is not None else [F.lit(None), F.lit(None)]
        found, low, high = rows.agg(F.collect_set(self.bucket_of(table, head)), *ends).first()
        return Keys(tuple(sorted(found)), low, high)

    def _schema(self, table: str) -> T.StructType:
        return T.StructType([*TABLES[table].fields, T.StructField("epoch", T.LongType())])

    def _paths(self, table: str, head: Head, keys: Keys | None) -> dict[str, list[str]]:
        """By the table they were written for."""
        paths: dict[str, list[str]] = {}
        for folder in head.folders.get(table, ()):
            owner, name = folder.split("/") if "/" in folder else (table, folder)
            path, holds = f"{self.root}/{owner}/{name}", head.holds.get(folder)
            if holds is None:
                paths.setdefault(owner, []).append(path)
            elif keys is None or keys.may_be_in(holds):
                whole = holds["buckets"] == holds["written"]
                # Buckets that a later commit has replaced are left out.
                some = ",".join(map(str, holds["buckets"]))
                paths.setdefault(owner, []).append(path if whole else f"{path}/epoch=*/bucket={{{some}}}")
        return paths

    def read(self, table: str, head: Head | None = None, keys: Keys | None = None) -> DataFrame:
        """SRC-4: committed rows of a table, with their `epoch`. Lists the commit's folders only;
        with `keys`, at least all rows of those keys, from the folders and buckets that may hold them."""
        head = head or self.head()
        paths = self._paths(table, head, keys)
        if not paths:
            # Folded to an empty relation at planning time, so joins with it vanish.
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema(table)]
            return self.spark.range(1).filter(F.lit(False)).select(*none)
        parts = []
        for owner, folders in paths.items():
            levels = [T.StructField("attempt", T.StringType())]
            if owner in BUCKETED_BY:
                levels.append(T.StructField("bucket", T.IntegerType()))
            schema = T.StructType([*self._schema(table).fields, *levels])
            rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{owner}").parquet(*folders)
            if keys is not None:
                rows = rows.filter(F.col("bucket").isin(*keys.buckets))
            parts.append(rows.drop("attempt", "bucket"))
        return with_derived(reduce(DataFrame.unionByName, parts), table)

    def summary(self, head: Head | None = None, keys: Keys | None = None) -> DataFrame:
        """The newest site snapshot."""
        return self.read("site_summary", head, keys)

    def pending(self, head: Head | None = None) -> DataFrame:
        """Events that are not delivered, with the state of their delivery."""
        return self.read("events_pending", head).drop("epoch").withColumn("published_at", F.lit(None).cast("timestamp"))

    def write(
        self,
        df: DataFrame,
        table: str,
        epoch: int,
        head: Head | None = None,
        replaces: tuple[int, ...] = (),
        late: Callable[[DataFrame], DataFrame] | None = None,
    ) -> Written:
        """Write rows of an epoch to a folder of their own, for a later commit.

        `replaces`: the buckets of a snapshot that the rows are the new state of. `late` makes
        the table's columns of narrower rows that have those of BUCKETED_BY, so that only the
        narrow ones are dealt to the buckets.
        """
        names = TABLES[table].fieldNames()

        def finish(rows: DataFrame, *more: str) -> DataFrame:
            made = late(rows) if late is not None else rows
            return made.select(*names, F.lit(epoch).alias("epoch"), *more)

        return self._written(df if late is not None else df.select(*names), table, head or self.head(), replaces, finish)

    def _written(
        self,
        df: DataFrame,
        table: str,
        head: Head,
        replaces: tuple[int, ...] = (),
        finish: Callable[..., DataFrame] = lambda rows, *more: rows,
    ) -> Written:
        self.commits.way()  # before any work: what is written here can be committed safely
        folder = f"attempt={uuid.uuid4().hex}"
        text = key_text(table) if table in BUCKETED_BY else None
        seen = None
        if text is not None:  # known from the write itself, without another pass
            seen = Observation()
            df = df.observe(seen, F.min(text).alias("low"), F.max(text).alias("high"))
        if table in BUCKETED_BY:
            # One writer a bucket, and four for a bucket that a hot site or device fills.
            order = ["bucket", *BUCKETED_BY[table]]
            first = [c for c in TABLES[table].fieldNames()[:4] if c in df.columns]
            spread = F.pmod(F.xxhash64(F.lit("spread"), *first), F.lit(4))
            df = df.withColumn("bucket", self.bucket_of(table, head)).repartition("bucket", spread).sortWithinPartitions(*order)
            df = finish(df, "bucket")
        else:
            df = finish(df)
        df = without_derived(df, table)
        writer = df.write.mode("errorifexists").partitionBy("epoch", *PARTITIONED_BY.get(table, []))
        # Hex ids and digests fill the rows: the default codec hardly makes them smaller.
        writer.parquet(f"{self.root}/{table}/{folder}", compression="zstd")
        if table not in BUCKETED_BY:
            return Written(table, folder)
        names = [n for e in self._names(f"{table}/{folder}") if e.startswith("epoch=") for n in self._names(f"{table}/{folder}/{e}")]
        buckets = sorted({int(n.partition("=")[2]) for n in names if n.startswith("bucket=")})
        ends = seen.get if seen is not None and buckets else {}  # a plan known to be empty reports nothing
        holds = {"buckets": buckets, "written": buckets, "low": ends.get("low"), "high": ends.get("high")}
        return Written(table, folder, holds, replaces)

    # ---- upkeep --------------------------------------------------------------
    def compact(self, tables: list[str] | None = None, folders: int = 32) -> int:
        """Rewrite tables of more than `folders` folders as one folder, and commit that.

        Rows, their epochs and order of arrival stay as they are; readers that opened an
        earlier commit still find its folders until `vacuum`.
        """
        head = self.head()
        due = [t for t in tables or sorted(head.tables) if len(head.folders.get(t, ())) > folders]
        if not due:
            return head.epoch
        wrote = []
        for table in due:
            rows = self.read(table, head)
            levels = ["epoch", *(["month"] if table == "measurements" else [])]
            if table not in BUCKETED_BY:
                rows = rows.repartitionByRange(*levels).sortWithinPartitions(*levels)
            wrote.append(self._written(rows.select(*TABLES[table].fieldNames(), "epoch"), table, head))
        return self.commit(head, wrote, datetime.now(timezone.utc), replaced=True)

    def vacuum(self, older_than_seconds: float = 7 * 86400) -> int:
        """Delete folders that the newest commit does not list and that are older than any
        reader or writer that may still use them. Returns how many went."""
        head, gone = self.head(), 0
        listed = {f if "/" in f else f"{t}/{f}" for t, folders in head.folders.items() for f in folders}
        for table in TABLES:
            for folder in self._names(table):
                if f"{table}/{folder}" in listed:
                    continue
                path, fs = self._path(f"{table}/{folder}")
                if time.time() * 1000 - fs.getFileStatus(path).getModificationTime() > older_than_seconds * 1000:
                    fs.delete(path, True)
                    gone += 1
        return gone
