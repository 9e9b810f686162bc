"""Incremental processing with a ledger of work items.

A ledger is a folder with one small log per work item: entry files numbered
1, 2, ... of which each can be created only once (exclusive create), so the
history of an item is linear whoever writes.  States: pending, leased (until a
time), done.  An expired lease counts as pending.  The number of a lease's
entry is its fencing token: a writer that wants to complete an item must
create the very next entry, which fails if anyone leased the item since.
Output goes to a path made from item and token, so a retried task or a stale
writer never touches what a later lease wrote, and readers take only the paths
that ``done`` entries name.  Item counts are a parameter (buckets of records),
so the driver's part doesn't grow with the data.

Runs are numbered, and each has a ledger of its own.  A run begins with one
snapshot of what is due (an item like any other), works off its buckets from
that snapshot, and ends with one entry that makes its rows and its checkpoints
count together.  A run that broke off is continued; only when the last run has
ended does the next one begin.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import _filesystem
from .current import latest_by

PENDING, LEASED, DONE = "pending", "leased", "done"
#: Items of a run besides its buckets: the snapshot of what is due, and the run's end.
PLAN, END = 1_000_000, 1_000_001
#: File systems whose create without overwriting is exclusive; "file" is done by a hard link.
EXCLUSIVE = ("file", "hdfs", "viewfs", "abfs", "abfss")


class StaleLease(Exception):
    """The lease isn't the item's latest entry any more."""


@dataclass(frozen=True)
class Lease:
    item: int
    token: int
    owner: str
    until: float


class RunUnfinished(Exception):
    """Items of the run are leased to others; call again later."""


class Ledger:
    """Work items and their states below ``path``, which must be shared.

    The file system must be able to create a file only if it isn't there:
    stores that check first and then write would let two writers hold one
    token, so others than EXCLUSIVE are refused.
    """

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock
        self.fs, at = _filesystem(spark, path)
        self.scheme = self.fs.getUri().getScheme()
        self.local = at.toUri().getPath() if self.scheme == "file" else None
        if self.scheme not in EXCLUSIVE:
            raise ValueError(f"no exclusive create on {self.scheme}: a ledger needs one of {', '.join(EXCLUSIVE)}")

    def _at(self, *parts: object):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))

    def _append(self, item: int, number: int, entry: dict) -> bool:
        """Create entry ``number`` of an item; False if it exists already."""
        data = json.dumps(entry).encode()
        parts = ("log", f"item={item}", f"{number:08d}.json")
        if self.local is not None:
            # A link appears whole and only if nothing is there.
            folder = os.path.join(self.local, *parts[:2])
            os.makedirs(folder, exist_ok=True)
            own = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(own, "wb") as f:
                f.write(data)
            try:
                os.link(own, os.path.join(folder, parts[2]))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
        final = self._at(*parts)
        if self.fs.exists(final):
            return False
        try:
            out = self.fs.create(final, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return True

    def _entries(self, item: int) -> list[tuple[int, dict]]:
        found = []
        at = self._at("log", f"item={item}")
        if not self.fs.exists(at):
            return found
        for s in self.fs.listStatus(at):
            name = s.getPath().getName()
            if name.endswith(".json") and not name.startswith("."):
                stream = self.fs.open(s.getPath())
                try:
                    raw = bytes(stream.readAllBytes())
                finally:
                    stream.close()
                # An entry cut short by a crash counts as pending: its number is used up, nothing else.
                try:
                    entry = json.loads(raw.decode())
                except ValueError:
                    entry = {"state": PENDING}
                found.append((int(name[:-5]), entry))
        return sorted(found, key=lambda x: x[0])

    def state(self, item: int) -> tuple[str, int, dict]:
        """State, number of the last entry and that entry (expired leases: pending)."""
        entries = self._entries(item)
        if not entries:
            return "absent", 0, {}
        number, last = entries[-1]
        state = last["state"]
        if state == LEASED and last["until"] <= self.clock():
            state = PENDING
        return state, number, last

    def items(self) -> list[int]:
        at = self._at("log")
        if not self.fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().removeprefix("item=")) for s in self.fs.listStatus(at))

    def enqueue(self, items: Sequence[int]) -> None:
        """Make items pending; one that is known already stays as it is."""
        for item in items:
            self._append(item, 1, {"state": PENDING})

    def lease(self, owner: str, seconds: float, limit: int | None = None, only: Sequence[int] | None = None) -> list[Lease]:
        """Lease up to ``limit`` pending items (of ``only``)."""
        got: list[Lease] = []
        for item in self.items() if only is None else only:
            if limit is not None and len(got) >= limit:
                break
            state, number, _ = self.state(item)
            until = self.clock() + seconds
            if state == PENDING and self._append(item, number + 1, {"state": LEASED, "owner": owner, "until": until}):
                got.append(Lease(item, number + 1, owner, until))
        return got

    def output(self, lease: Lease) -> str:
        return f"{self.path}/out/token={lease.token}/item={lease.item}"

    def complete(self, lease: Lease) -> None:
        """Mark an item done; StaleLease if it was leased again meanwhile."""
        if not self._append(lease.item, lease.token + 1, {"state": DONE, "token": lease.token, "owner": lease.owner}):
            raise StaleLease(f"item {lease.item}: token {lease.token} is not the latest")

    def done(self, only: Sequence[int] | None = None) -> list[tuple[int, int]]:
        """(item, token) of all done items (of ``only``)."""
        found = []
        for item in self.items() if only is None else only:
            state, _, last = self.state(item)
            if state == DONE:
                found.append((item, last["token"]))
        return found


def run_leased(ledger: Ledger, work: DataFrame, item_col: str, owner: str, lease_seconds: float = 3600, limit: int | None = None, only: Sequence[int] | None = None) -> int:
    """Lease pending items, write their rows of ``work``, complete them.

    One Spark job writes all leased items, each to the path of its token (a
    retried job overwrites just these).  Returns how many items were completed;
    those that someone leased meanwhile are left to them.
    """
    leases = ledger.lease(owner, lease_seconds, limit, only)
    by_token: dict[int, list[Lease]] = {}
    for x in leases:
        by_token.setdefault(x.token, []).append(x)
    completed = 0
    for token, group in by_token.items():
        rows = work.where(F.col(item_col).isin([x.item for x in group])).withColumnRenamed(item_col, "item").hint("rebalance", "item")
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("item").parquet(f"{ledger.path}/out/token={token}"))
        for x in group:
            try:
                ledger.complete(x)
                completed += 1
            except StaleLease:
                pass
    return completed


def accepted(ledger: Ledger, schema, only: Sequence[int] | None = None) -> DataFrame:
    """All rows of done items (of ``only``), each item from the token that completed it."""
    paths = [p for item, token in ledger.done(only) if ledger.fs.exists(ledger._at(*(p := f"out/token={token}/item={item}").split("/")))]
    if not paths:
        return ledger.spark.createDataFrame([], schema)
    return ledger.spark.read.schema(schema).parquet(*(f"{ledger.path}/{p}" for p in paths))


def due_versions(source: DataFrame, channels: DataFrame, stored: DataFrame) -> DataFrame:
    """What the next run must take in: message_id, edited_at (of its newest version), place.

    Due are ids not stored yet that lie above the checkpoint of their thread
    (channel without one), or whose thread or channel was never fetched (no row
    or only nulls), and ids whose newest delivered version has a later
    edited_at than the current stored row (null before all).  System records
    don't count; rows without an id are ignored; repeated rows change nothing;
    is_system null counts as false.  Empty tables are allowed in every place.
    """
    versions = source.where(~F.coalesce(F.col("is_system"), F.lit(False)) & F.col("id").isNotNull())
    versions = versions.select("id", "edited_at", F.coalesce("thread_id", "channel_id").alias("place"))
    newest = latest_by(versions, ["id"], ["edited_at", "place"], ["edited_at", "place"])
    here = stored.where(F.col("id").isNotNull()).select("id", "ingested_at", F.col("edited_at").alias("stored_edit"))
    here = latest_by(here, ["id"], ["ingested_at", "stored_edit"], ["stored_edit"]).withColumn("there", F.lit(True))
    marks = channels.groupBy(F.col("id").alias("place")).agg(F.max("last_backfilled_message_id").alias("mark"))
    # Stored ids first: both sides are already partitioned by id.
    found = newest.join(here, "id", "left")
    found = found.join(marks, "place", "left")
    new = F.col("there").isNull() & (F.col("mark").isNull() | (F.col("id") > F.col("mark")))
    edited = F.col("there") & F.col("edited_at").isNotNull() & (F.col("stored_edit").isNull() | (F.col("edited_at") > F.col("stored_edit")))
    return found.where(new | edited).select(F.col("id").alias("message_id"), "edited_at", "place")


def due_records(source: DataFrame, channels: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids (``message_id``) of ``due_versions``."""
    return due_versions(source, channels, stored).select("message_id")


class Runs:
    """The numbered runs below ``path``; every one has a ledger of ``buckets`` items, a plan and an end."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 24, clock: Callable[[], float] = time.time, schema="message_id long, edited_at timestamp_ntz, place long"):
        self.spark, self.path, self.buckets, self.clock, self.schema = spark, path.rstrip("/"), buckets, clock, schema

    def ledger(self, run: int) -> Ledger:
        return Ledger(self.spark, f"{self.path}/run={run:08d}", self.clock)

    def known(self) -> list[int]:
        """Numbers of all runs that were begun."""
        fs, at = _filesystem(self.spark, self.path)
        return sorted(int(s.getPath().getName().removeprefix("run=")) for s in fs.listStatus(at)) if fs.exists(at) else []

    def finished(self, run: int) -> bool:
        return self.ledger(run).state(END)[0] == DONE

    def open(self) -> int:
        """The run that is to be worked on: the last one if it hasn't ended, else the next number."""
        known = self.known()
        return 1 if not known else known[-1] + 1 if self.finished(known[-1]) else known[-1]

    def rows(self, run: int) -> DataFrame:
        """message_id, edited_at, place of a run that has ended (none of one that hasn't)."""
        l = self.ledger(run)
        return accepted(l, self.schema, range(self.buckets) if self.finished(run) else ())

    def taken(self) -> DataFrame | None:
        """The latest version that ended runs took in of every id: t_id, t_edit; None without runs."""
        every = None
        for run in self.known():
            if self.finished(run):
                one = self.rows(run)
                every = one if every is None else every.unionByName(one)
        return None if every is None else every.groupBy(F.col("message_id").alias("t_id")).agg(F.max("edited_at").alias("t_edit"))

    def advanced(self, channels: DataFrame) -> DataFrame:
        """The checkpoints after all ended runs: id, last_backfilled_message_id.

        A run's checkpoints count from the moment at which its rows do, as both
        hang on its one end entry.  Checkpoints never fall.
        """
        marks = channels.select("id", "last_backfilled_message_id")
        for run in self.known():
            marks = marks.unionByName(self.rows(run).groupBy(F.col("place").alias("id")).agg(F.max("message_id").alias("last_backfilled_message_id")))
        return marks.groupBy("id").agg(F.max("last_backfilled_message_id").alias("last_backfilled_message_id"))

    def work(self, due: DataFrame, owner: str, lease_seconds: float = 3600) -> int:
        """Begin or continue a run over ``due``; its number once it has ended.

        ``due`` is only looked at by whoever makes the run's snapshot: what the
        tables hold by the time a run is continued makes no difference to it.
        Raises RunUnfinished while others hold items of the run.
        """
        run = self.open()
        l = self.ledger(run)
        l.enqueue([PLAN])
        for lease in l.lease(owner, lease_seconds, only=[PLAN]):
            taken = self.taken()
            if taken is not None:
                again = F.col("t_id").isNull() | (F.col("edited_at").isNotNull() & (F.col("t_edit").isNull() | (F.col("edited_at") > F.col("t_edit"))))
                due = due.join(taken, F.col("message_id") == F.col("t_id"), "left").where(again).drop("t_id", "t_edit")
            bucket = F.pmod(F.xxhash64("message_id"), F.lit(self.buckets)).cast("int")
            rows = due.withColumn("bucket", bucket).hint("rebalance", "bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(l.output(lease))
            try:
                l.complete(lease)
            except StaleLease:
                pass
        plan = l.done([PLAN])
        if not plan:
            raise RunUnfinished(f"run {run}: someone else makes its snapshot")
        at = f"{l.path}/out/token={plan[0][1]}/item={PLAN}"
        snapshot = self.spark.read.schema(due.withColumn("bucket", F.lit(0)).schema).parquet(at)
        every = range(self.buckets)
        l.enqueue(every)
        run_leased(l, snapshot, "bucket", owner, lease_seconds, only=every)
        done = l.done(every)
        if len(done) < self.buckets:
            raise RunUnfinished(f"run {run}: {self.buckets - len(done)} items are leased to others")
        l._append(END, 1, {"state": DONE, "token": 0, "owner": owner})  # whoever is first; all would write the same
        return run


def take_in(source: DataFrame, channels: DataFrame, stored: DataFrame, path: str, buckets: int = 24, owner: str = "run", clock: Callable[[], float] = time.time, lease_seconds: float = 3600) -> DataFrame:
    """The ids (``message_id``) of the next run, taken in through the ledgers at ``path``.

    A run that broke off is continued by calling this again with the same path:
    its snapshot stays, done items aren't repeated, and items whose lease
    expired are taken again.  Once a run has ended the next call begins another
    one over what is due then; ids that ended runs took in already are due
    again only in a later version, whether or not ``stored`` and ``channels``
    know of them yet.  ``Runs.rows`` gives the rows of earlier runs again, and
    ``Runs.advanced`` the checkpoints to be kept.
    """
    due = due_versions(source, channels, stored)
    runs = Runs(source.sparkSession, path, buckets, clock, due.schema)
    return runs.rows(runs.work(due, owner, lease_seconds)).select("message_id")
