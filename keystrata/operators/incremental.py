"""Processing only new or changed records: a ledger of work items with leases and fencing tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from keystrata._util import P, cut_lineage, require, small
from keystrata.operators.ordered import ordered

LEDGER = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("event", T.StringType()),  # PENDING | LEASED | DONE
        T.StructField("token", T.LongType()),
        T.StructField("worker", T.StringType()),
        T.StructField("at", T.LongType()),
        T.StructField("until", T.LongType()),
        T.StructField("position", T.LongType()),  # of a DONE: how far a reader has come; NULL for an item done as a whole
    ]
)
EVENTS = LEDGER.names[1:]


def ledger_state(events: DataFrame, now: int | Column, items: list[str] | None = None, rewinds: bool = False) -> DataFrame:
    """Fold ledger events into ``(items..., state, token, position)``; state is pending, leased or done.

    Tokens rise with the leases of an item, so a DONE is accepted if the item wasn't leased under a higher token before it:
    a writer whose lease had been handed on by then is stale, and what it reports changes nothing (fencing). A DONE
    without a lease of its token counts for nothing either. An accepted DONE stands, whatever was leased later.

    An item done as a whole (no position) is done then. An item that is a reader with a position goes on: it is done up
    to the largest accepted position, or, if it ``rewinds``, that of the accepted DONE with the highest token. A lease that
    is neither answered nor run out makes an item leased; else it is pending, as is one whose lease was never taken.

    Events come in any order and repeated. One row per attempt is left by an aggregate with map-side combine; which
    lease follows which is found by the ordered operator, so an item with a third of all attempts is split.
    """
    items = items or ["item"]
    lease, done = F.col("event") == "LEASED", F.col("event") == "DONE"
    named = events.where(" AND ".join(f"`{c}` IS NOT NULL" for c in items))
    tries = named.groupBy(*items, "token").agg(
        F.min(F.when(lease, F.col("at"))).alias(f"{P}from"), F.max(F.when(lease, F.col("until"))).alias(f"{P}until"),
        F.min(F.when(done, F.col("at"))).alias(f"{P}done"), F.max(F.when(done, F.col("position"))).alias(f"{P}pos"),
    )
    leased = F.col(f"{P}from").isNotNull()
    tried = ordered(tries, items, [F.col("token")], next_mins={f"{P}next": F.col(f"{P}from")})
    good = leased & F.col(f"{P}done").isNotNull() & (F.col(f"{P}next").isNull() | (F.col(f"{P}next") >= F.col(f"{P}done")))
    last = F.struct("token", F.col(f"{P}until").alias("until"), F.col(f"{P}done").isNotNull().alias("over"))
    position = F.max(F.when(good & F.col(f"{P}pos").isNotNull(), F.struct("token", f"{P}pos")))[f"{P}pos"] if rewinds else F.max(F.when(good, F.col(f"{P}pos")))
    per = tried.groupBy(*items).agg(
        F.max(F.when(leased, last)).alias(f"{P}last"), F.max(good & F.col(f"{P}pos").isNull()).alias(f"{P}whole"), position.alias("position")
    )
    running = (F.col(f"{P}last.until") > (F.lit(now) if isinstance(now, int) else now)) & ~F.col(f"{P}last.over")
    state = F.when(F.col(f"{P}whole") & F.col("position").isNull(), "done").when(running, "leased").otherwise("pending")
    return per.select(*items, state.alias("state"), F.coalesce(f"{P}last.token", F.lit(0)).alias("token"), "position")


class BatchTaken(Exception):
    """Another coordinator has committed the number that this one's batch was made for."""


class WorkLedger:
    """A ledger kept as Parquet in a shared folder, for any number of coordinators at once.

    A batch of events is made from the batches before it, and counts only under the number that follows those. Its rows
    go to a folder of their own under ``batches``; the commit is a small file under ``events``, named by the number, that
    holds the folder's name and appears whole or not at all, and only where there is none. So of two coordinators that
    act on the same state one reads again and decides anew, and neither touches what the other is writing. Folders that
    no commit names are never read; ``sweep`` removes old ones. ``output_path`` depends on the item alone: an attempt
    that is repeated overwrites what an earlier one left, and readers see each item once.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: int):
        self.spark, self.path, self.ttl = spark, path.rstrip("/"), ttl
        self.jvm = spark.sparkContext._jvm

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list:
        fs, root = self._fs(), self._at(name)
        return list(fs.listStatus(root)) if fs.exists(root) else []

    def _batches(self) -> dict[int, str]:
        """The folder of each committed batch by its number."""
        fs, out = self._fs(), {}
        for st in self._listed("events"):
            if not (name := st.getPath().getName()).isdigit():
                continue
            stream = fs.open(st.getPath())
            try:
                out[int(name)] = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        return out

    def _read(self) -> tuple[DataFrame, int]:
        """The events, and the number that a batch made from them has to take."""
        batches = self._batches()
        folders = [f"{self.path}/batches/{b}" for b in batches.values()]
        events = self.spark.read.schema(LEDGER).parquet(*folders) if folders else self.spark.createDataFrame([], LEDGER)
        return events, max(batches, default=-1) + 1

    def events(self) -> DataFrame:
        return self._read()[0]

    def _claim(self, number: int, folder: str) -> None:
        """Commit the folder under the number; raises ``BatchTaken``, changing nothing, if the number has a commit.

        The commit file is written aside and then linked (local files) or renamed without overwriting, which a shared
        file system must do in one step, as HDFS does.
        """
        fs, aside, target = self._fs(), self._at("events", f"_{folder}"), self._at("events", f"{number:012d}")
        out = fs.create(aside, False)
        out.write(bytearray(folder.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                link, existing = (self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, aside))
                self.jvm.java.nio.file.Files.createLink(link, existing)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise BatchTaken(number) from e
            raise
        finally:
            fs.delete(aside, False)

    def _append(self, df: DataFrame, number: int) -> None:
        """Write a batch and commit it under ``number``; raises ``BatchTaken`` if another has it."""
        folder = uuid.uuid4().hex
        df.select([F.col(f.name).cast(f.dataType) for f in LEDGER]).write.mode("errorifexists").parquet(f"{self.path}/batches/{folder}")
        try:
            self._claim(number, folder)
        except BatchTaken:
            self._fs().delete(self._at("batches", folder), True)
            raise

    def _decide(self, decide: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """Append the batch that ``decide`` makes of the events, and return its result; again from the start if overtaken."""
        while True:
            events, number = self._read()
            batch, result = decide(events)
            try:
                self._append(batch, number)
                return result
            except BatchTaken:
                continue  # another batch got in, so the ledger as a whole has moved on

    def sweep(self, age_ms: int) -> None:
        """Remove folders that no commit names and that were last changed more than ``age_ms`` ago (crashed writers).

        The age must exceed the time that the longest write of a batch can take.
        """
        fs, before = self._fs(), self.jvm.java.lang.System.currentTimeMillis() - age_ms
        old = [st.getPath() for st in self._listed("batches") if st.getModificationTime() < before]
        named = set(self._batches().values())
        for p in old:
            if p.getName() not in named:
                fs.delete(p, True)

    def register(self, items: DataFrame, now: int) -> None:
        """Add items not yet known. NULL items are ignored, repeated ones count once."""
        require(items, "item")

        def decide(events: DataFrame) -> tuple[DataFrame, DataFrame]:
            known = events.select("item").distinct()
            fresh = items.select("item").where(F.col("item").isNotNull()).distinct().join(known, "item", "left_anti")
            return fresh.select("item", F.lit("PENDING").alias("event"), F.lit(0).alias("token"), F.lit(None).alias("worker"), F.lit(now).alias("at"), F.lit(None).alias("until"), F.lit(None).alias("position")), fresh

        self._decide(decide)

    def state(self, now: int) -> DataFrame:
        return ledger_state(self.events(), now)

    def lease(self, worker: str, n: int, now: int) -> DataFrame:
        """Lease up to ``n`` pending items, lowest names first, each under the next token; returns ``(item, token)``."""

        def decide(events: DataFrame) -> tuple[DataFrame, DataFrame]:
            free = ledger_state(events, now).where(F.col("state") == "pending").orderBy("item").limit(n)
            taken = cut_lineage(free.select("item", (F.col("token") + 1).alias("token")))
            return taken.select("item", F.lit("LEASED").alias("event"), "token", F.lit(worker).alias("worker"), F.lit(now).alias("at"), F.lit(now + self.ttl).alias("until"), F.lit(None).alias("position")), taken

        return self._decide(decide)

    def complete(self, leased: DataFrame, worker: str, now: int) -> DataFrame:
        """Record leased items as done; returns the accepted ``(item, token)``. Stale tokens are rejected."""

        def decide(events: DataFrame) -> tuple[DataFrame, DataFrame]:
            current = ledger_state(events, now).where(F.col("state") != "done")
            good = cut_lineage(leased.select("item", "token").join(current.select("item", "token"), ["item", "token"], "left_semi"))
            return good.select("item", F.lit("DONE").alias("event"), "token", F.lit(worker).alias("worker"), F.lit(now).alias("at"), F.lit(None).alias("until"), F.lit(None).alias("position")), good

        return self._decide(decide)

    def output_path(self, item: str) -> str:
        return f"{self.path}/out/item={item}"

    def run(self, worker: str, n: int, clock: Callable[[], int], work: Callable[[DataFrame, "WorkLedger"], None]) -> DataFrame:
        """Lease, work, complete. If ``work`` raises, the lease runs out and the items are pending again."""
        leased = self.lease(worker, n, clock())
        work(leased, self)
        return self.complete(leased, worker, clock())


def attempts(rows: DataFrame, reader: list[str], token: Column, begun: Column, lease: int, over: Column, succeeded: Column, position: Column) -> DataFrame:
    """Ledger events ``(reader..., event, token, worker, at, until, position)`` of recorded attempts of readers.

    An attempt took a lease of ``lease`` when it had ``begun``. If it succeeded and says how far it came, it is DONE at
    ``over``; one that was killed, failed or never answered leaves its lease to run out. Rows without reader, token or
    beginning are no attempts.
    """
    told = rows.select(*reader, token.alias("token"), begun.alias(f"{P}b"), F.coalesce(over, begun).alias(f"{P}e"), succeeded.alias(f"{P}ok"), position.alias(f"{P}p"))
    told = told.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*reader, "token", f"{P}b"]))
    no = F.lit(None)
    taken = F.struct(F.lit("LEASED").alias("event"), F.col(f"{P}b").alias("at"), (F.col(f"{P}b") + F.lit(lease)).alias("until"), no.cast("bigint").alias("position"))
    done = F.struct(F.lit("DONE").alias("event"), F.col(f"{P}e").alias("at"), no.cast("bigint").alias("until"), F.col(f"{P}p").alias("position"))
    both = F.when(F.col(f"{P}ok") & F.col(f"{P}p").isNotNull(), F.array(taken, done)).otherwise(F.array(taken))
    return told.select(*reader, "token", F.explode(both).alias(f"{P}v")).select(*reader, f"{P}v.event", "token", no.cast("string").alias("worker"), f"{P}v.at", f"{P}v.until", f"{P}v.position")


def stretches(events: DataFrame, reader: list[str], state: DataFrame) -> DataFrame:
    """``(reader..., upto, state, tries)``: the work between the positions that attempts of a reader came to.

    ``events`` are those of ``attempts`` with a position on every lease that knew one, ``state`` their ``ledger_state``. A
    stretch ends at ``upto`` and begins behind the one before; it is done if it lies at or before the reader's position,
    else in the reader's state. ``tries`` counts the attempts that reached at least so far.
    """
    ends = events.where(F.col("position").isNotNull()).groupBy(*reader, F.col("position").alias("upto")).agg(F.count_distinct("token").alias(f"{P}n"))
    reached = ordered(ends, reader, [-F.col("upto")], sums={"tries": F.col(f"{P}n")})
    got = reached.join(state.select(*reader, F.col("state").alias(f"{P}s"), "position"), reader)
    done = F.coalesce(F.col("upto") <= F.col("position"), F.lit(False))
    return got.select(*reader, "upto", F.when(done, "done").otherwise(F.col(f"{P}s")).alias("state"), "tries")


def pending_messages(entries: DataFrame, readers: DataFrame, ids: list[str], owner: str, pos: str) -> DataFrame:
    """The distinct identifiers that the ledger hands out: no copy is done, and a copy's owner isn't under lease.

    A copy is done if it lies at or before the position of its own owner. ``readers`` is a ``ledger_state`` by owner;
    an owner that it lacks has nothing taken in and no lease. It is broadcast only if measured small. Rows at or before
    a position travel as identifiers alone, combined on the map side. Rows lacking part of ``ids`` are left out.
    """
    require(entries, *ids, owner, pos)
    at = readers.select(F.col(owner).alias(f"{P}o"), F.col("position").alias(f"{P}p"), (F.col("state") == "leased").alias(f"{P}l"))
    held = small(at)
    rows = entries.select(*ids, owner, pos).where(" AND ".join(f"`{c}` IS NOT NULL" for c in ids))
    seen, free = F.coalesce(F.col(pos) <= F.col(f"{P}p"), F.lit(False)), ~F.coalesce(F.col(f"{P}l"), F.lit(False))
    marked = rows.join(at if held is None else F.broadcast(held), F.col(owner) == F.col(f"{P}o"), "left")
    per = marked.groupBy(*ids).agg(F.max(seen).alias(f"{P}seen"), F.max(free).alias(f"{P}free"))
    return per.where(~F.col(f"{P}seen") & F.col(f"{P}free")).select(*ids)


def pending_versions(diffs: DataFrame, members: DataFrame, readers: DataFrame, stream: str, member: str, version: str, recorded: str) -> DataFrame:
    """``(stream, member, version)`` of every recorded version that a member of the stream has not taken in.

    ``readers`` is a ``ledger_state`` by stream and member: ``position`` is the next version wanted, ``token`` the time of
    the DONE that said so (``ledger_state`` with ``rewinds`` over acknowledgements alone). A version counts as taken in
    if it lies below that position and was recorded by then; one that was recorded later, below the position, is still
    pending. Members under lease are handed nothing. Each version meets the members of its own stream alone; where they
    are too many to broadcast, a stream is dealt out by a hash of the version, so that no task has all of a stream.
    """
    known = diffs.where(F.col(stream).isNotNull() & F.col(version).isNotNull()).groupBy(stream, version).agg(F.min(recorded).alias(f"{P}at"))
    who = members.where(F.col(stream).isNotNull() & F.col(member).isNotNull()).select(stream, member).distinct()
    who = who.join(readers.select(stream, member, "state", "token", "position"), [stream, member], "left").where("state IS NULL OR state != 'leased'")
    taken = F.coalesce((F.col("position") > F.col(version)) & (F.col("token") >= F.col(f"{P}at")), F.lit(False))
    held = small(who)
    if held is not None:
        met = known.join(F.broadcast(held), stream)
    else:
        n = int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = known.withColumn(f"{P}d", F.pmod(F.xxhash64(version), F.lit(n)).cast("int"))
        met = dealt.join(who.withColumn(f"{P}d", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), [stream, f"{P}d"])
    return met.where(~taken).select(stream, member, version)
