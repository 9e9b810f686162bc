"""One cycle of an archive: take in, group, score, decide; repeated, it never does anything twice.

State is a folder of tables with one part per cycle.  A cycle reads the parts
of the cycles before it, writes its own, and ends with a mark; a cycle that
broke off has no mark, is done over, and overwrites its parts.  So a late
message cannot reopen an exchange that was closed: it forms a new one whose
parent is the old one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import classify as C
from ..operators import grouping as G
from ..operators.current import latest_by
from ..operators.ledger import Runs, due_versions
from ..storage import _filesystem, settle

MESSAGES = "id long, channel_id long, thread_id long, author_id long, bot boolean, content string, us long, reply_to_id long, edited_at timestamp_ntz, ingested_at long"
EXCHANGES = "xid long, id long, position long"
PARENTS = "xid long, parent long"
SCORES = "xid long, score double, reasons string, stage string, decision string"


@dataclass(frozen=True)
class Report:
    cycle: int
    messages: int
    exchanges: int
    scored: int


class Archive:
    """The tables below ``path``, which must be shared."""

    def __init__(self, spark: SparkSession, path: str, patterns: dict[str, tuple[str, float]], terms: str, gap_us: int = 1_800_000_000, fold_us: int = 7_200_000_000, most: int = 50, overlap: int = 3, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.patterns, self.terms, self.clock = spark, path.rstrip("/"), patterns, terms, clock
        self.gap_us, self.fold_us, self.most, self.overlap = gap_us, fold_us, most, overlap

    def _exists(self, at: str) -> bool:
        fs, p = _filesystem(self.spark, f"{self.path}/{at}")
        return fs.exists(p)

    def ended(self) -> int:
        """The number of the last cycle that ended (0: none)."""
        fs, p = _filesystem(self.spark, f"{self.path}/marks")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def read(self, name: str, schema: str, upto: int | None = None) -> DataFrame:
        """A table: the parts of all ended cycles (of those up to ``upto``)."""
        last = self.ended() if upto is None else upto
        paths = [f"{self.path}/{name}/{n}" for n in range(1, last + 1) if self._exists(f"{name}/{n}")]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, cycle: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{cycle}")

    def messages(self, upto: int | None = None) -> DataFrame:
        """The latest version of every message."""
        m = self.read("messages", MESSAGES, upto)
        return latest_by(m, ["id"], ["ingested_at", "edited_at"], [c for c in m.columns if c not in ("id", "ingested_at")])

    def run_once(self, source: DataFrame, channels: DataFrame, now_us: int) -> Report:
        """One cycle.

        ``source``: id, channel_id, thread_id, author_id, author_is_bot,
        is_system, content, created_at, edited_at, reply_to_id; ``channels``:
        id, last_backfilled_message_id.  Exchanges are closed once nothing
        came for a gap before ``now_us``; open ones wait for a later cycle.
        """
        before = self.ended()
        cycle = before + 1
        old = self.messages(before)
        # Take in: every run that has ended and isn't stored yet, so that none is lost between the two.
        runs = Runs(self.spark, f"{self.path}/ledger", clock=self.clock)
        stored = old.withColumn("ingested_at", F.lit(0))
        due = due_versions(source, runs.advanced(channels), stored)
        runs.schema = due.schema
        run = runs.work(due, "cycle")
        taken = runs.rows(run)
        for n in runs.known():
            if n < run and runs.finished(n):
                taken = taken.unionByName(runs.rows(n))
        here = old.select(F.col("id").alias("h_id"), F.col("edited_at").alias("h_edit"), F.lit(True).alias("here"))
        wanted = taken.groupBy(F.col("message_id").alias("w_id")).agg(F.max("edited_at").alias("w_edit")).join(here, F.col("w_id") == F.col("h_id"), "left")
        wanted = wanted.where(F.col("here").isNull() | (F.col("w_edit").isNotNull() & (F.col("h_edit").isNull() | (F.col("w_edit") > F.col("h_edit"))))).select("w_id")
        s = source.where(~F.coalesce("is_system", F.lit(False))).withColumn("us", micros(source, "created_at")).select("id", "channel_id", "thread_id", "author_id", F.coalesce("author_is_bot", F.lit(False)).alias("bot"), "content", "us", "reply_to_id", "edited_at")
        s = latest_by(s, ["id"], ["edited_at", "us"], [c for c in s.columns if c != "id"])
        self._write("messages", cycle, s.join(wanted, F.col("id") == F.col("w_id"), "left_semi").withColumn("ingested_at", F.lit(cycle).cast("long")).select(*(x.split()[0] for x in MESSAGES.split(", "))))
        every = settle(self.messages(cycle), "messages")
        # Group what stands in no exchange yet; what is still open waits.
        grouped = self.read("exchanges", EXCHANGES, before)
        pool = settle(every.where("NOT bot AND us IS NOT NULL").join(grouped.select("id"), "id", "left_anti"), "pool")
        keys = settle(G.exchange_keys(pool, self.gap_us), "keys")
        last = pool.join(keys, "id").groupBy("channel_id", "key").agg(F.max("us").alias("last"))
        # Groups to which something may still come wait; the others are folded and split among themselves.
        open_ = last.where(F.col("last") >= now_us - self.gap_us).select(F.col("key").alias("o_key"))
        closed = keys.join(open_, F.col("key") == F.col("o_key"), "left_anti")
        parts = settle(G.final_groups(pool.join(closed.select(F.col("id").alias("c_id")), F.col("id") == F.col("c_id"), "left_semi"), closed, self.fold_us, 1, self.most, self.overlap), "parts")
        own = parts.where("NOT is_context").select(F.col("part").alias("xid"), "id", "position")
        self._write("exchanges", cycle, own)
        known = grouped.select("id", F.col("xid").alias("part"), "position").withColumn("is_context", F.lit(False))
        parents = G.parents(parts.select("id", "part", "position", "is_context").unionByName(known), every).join(own.select(F.col("xid").alias("part")).distinct(), "part", "left_semi")
        self._write("parents", cycle, parents.select(F.col("part").alias("xid"), "parent"))
        # Score and decide what has no score.
        exchanges = self.read("exchanges", EXCHANGES, cycle)
        todo = exchanges.join(self.read("scores", SCORES, before).select("xid"), "xid", "left_anti")
        em = settle(todo.join(every, "id").withColumn("content", F.coalesce("content", F.lit(""))), "unscored")
        scored = settle(C.rule_score(em, self.patterns, self.terms), "scored")
        hits = F.size(F.regexp_extract_all(F.lower("content"), F.lit(self.terms), F.lit(0)))
        subject = em.groupBy(F.col("xid").alias("id")).agg(F.lit(False).alias("denied"), F.sum(F.length(F.trim("content"))).alias("chars"), F.sum(hits).alias("hits"), (F.count_if(hits > 0) / F.count("*")).alias("share"))
        subject = subject.join(scored.select(F.col("xid").alias("s_id"), F.col("score").alias("p")), F.col("id") == F.col("s_id")).drop("s_id")
        decided = C.cascade(subject, 0.25, 60, 0.05, 0.6).select(F.col("id").alias("xid"), "stage", "decision")
        self._write("scores", cycle, scored.join(decided, "xid").select("xid", "score", "reasons", "stage", "decision"))
        report = Report(cycle, *(self.spark.read.parquet(f"{self.path}/{n}/{cycle}").count() for n in ("messages", "exchanges", "scores")))
        fs, mark = _filesystem(self.spark, f"{self.path}/marks/{cycle}")
        fs.mkdirs(mark)
        return report
