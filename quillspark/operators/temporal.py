"""Versioned keys and values: snapshots, chains, logs, their repair and their comparison.

A write log has (key, kind, s, n, ts, op, txn_id): kind 'S' for strings, 'N' for
numbers, 'D' for deletions; op orders the writes of one timestamp. Transactions
are (txn_id, ts, status): 'C' committed, 'P' pending, 'A' aborted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.paths import range_scan
from quillspark.storage import written

FOREVER = 9223372036854775807

#: The logical clock's first timestamp, its step, and the least one.
CLOCK_START, CLOCK_STEP, CLOCK_LEAST = 100, 10, 1

#: Numbers this near to each other are equal.
NUMBER_TOLERANCE = 1e-5


def timestamp(ts: Column) -> Column:
    """0 means for ever."""
    return F.when(ts == 0, F.lit(FOREVER)).otherwise(ts).cast("long")


def committed(log: DataFrame, txns: DataFrame) -> DataFrame:
    """Writes of committed transactions; those of aborted and pending ones are as if they had never been."""
    return log.join(txns.where("status = 'C'").select("txn_id"), "txn_id", "left_semi")


def version_chain(writes: DataFrame) -> DataFrame:
    """(key, kind, s, n, begin_ts, end_ts): each version ends where its key's next one begins; the last one never does.

    Of several writes of a key at one time the last one counts.
    """
    order = Window.partitionBy("key").orderBy("ts")
    one = writes.groupBy("key", "ts").agg(F.max_by(F.struct("kind", "s", "n"), "op").alias("v"))
    return one.select("key", "v.kind", "v.s", "v.n", F.col("ts").alias("begin_ts"), F.coalesce(F.lead("ts").over(order), F.lit(FOREVER)).alias("end_ts"))


def snapshot(versions: DataFrame, ts: int) -> DataFrame:
    """(key, kind, s, n) of every key as of a time, both ends of a version included and the later version preferred; deleted keys are not there."""
    at = FOREVER if ts == 0 else ts
    seen = versions.where((F.col("begin_ts") <= at) & (F.col("end_ts") >= at))
    last = seen.groupBy("key").agg(F.max_by(F.struct("kind", "s", "n"), "begin_ts").alias("v"))
    return last.where("v.kind <> 'D'").select("key", "v.*")


def snapshot_range(versions: DataFrame, prefix: str, ts: int) -> DataFrame:
    """snapshot() of the keys in a prefix's range."""
    return snapshot(range_scan(versions, prefix, "key"), ts)


def blocked_reads(reads: DataFrame, log: DataFrame, txns: DataFrame) -> DataFrame:
    """Reads (key, ts) that fail, as another transaction (not their own, in txn_id) has a pending write of the key at their time or before it."""
    pending = log.join(txns.where("status = 'P'").select("txn_id"), "txn_id", "left_semi")
    # the earliest pending write of a key, and the earliest of any other transaction than that
    first = pending.groupBy("key", "txn_id").agg(F.min("ts").alias("at")).groupBy("key").agg(F.min_by(F.struct("txn_id", "at"), F.struct("at", "txn_id")).alias("first"))
    others = pending.join(first, "key").where("txn_id <> first.txn_id").groupBy("key").agg(F.min("ts").alias("other"))
    held = reads.join(first, "key").join(others, "key", "left")
    own = F.col("txn_id").eqNullSafe(F.col("first.txn_id"))
    return held.where(F.when(own, F.col("other")).otherwise(F.col("first.at")) <= F.col("ts")).select("key", "ts", "txn_id")


def as_of_join(reads: DataFrame, versions: DataFrame) -> DataFrame:
    """reads (key, ts, ...) with kind, s, n of the latest version that had begun, null if there is none or it is a deletion.

    One sort a key over both tables, no join of all with all.
    """
    extra = [c for c in reads.columns if c not in ("key", "ts")]
    left = reads.select("key", "ts", F.lit(1).alias("_side"), F.struct(*extra, F.lit(0).alias("_")).alias("_read"), F.lit(None).cast("struct<kind:string,s:string,n:double>").alias("_v"))
    none = F.lit(None).cast(left.schema["_read"].dataType)
    right = versions.select("key", F.col("begin_ts").alias("ts"), F.lit(0).alias("_side"), none.alias("_read"), F.struct("kind", "s", F.col("n").cast("double").alias("n")).cast("struct<kind:string,s:string,n:double>").alias("_v"))
    order = Window.partitionBy("key").orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_got", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    live = F.when(F.col("_got.kind") != "D", F.col("_got"))
    return found.select("key", "ts", *[F.col("_read")[c].alias(c) for c in extra], live.getField("kind").alias("kind"), live.getField("s").alias("s"), live.getField("n").alias("n"))


def log_operations(wal: DataFrame) -> DataFrame:
    """(ts, op_no, op, key, kind, s, n) of a log of (timestamp, ops) records."""
    return wal.select(timestamp(F.col("timestamp")).alias("ts"), F.posexplode("ops").alias("op_no", "o")).select("ts", "op_no", "o.op", "o.key", "o.kind", "o.s", "o.n")


def replayed(wal: DataFrame) -> DataFrame:
    """(key, kind, s, n) after all records in order of their times: the last write of each key, deletions left out."""
    writes = log_operations(wal).where("op = 'Write'")
    last = writes.groupBy("key").agg(F.max_by(F.struct("kind", "s", "n"), F.struct("ts", "op_no")).alias("v"))
    return last.where("v.kind <> 'D'").select("key", "v.*")


def failed_reads(wal: DataFrame) -> DataFrame:
    """Logged reads (ts, op_no, key) whose value isn't that of the last write before them."""
    ops = log_operations(wal)
    order = Window.partitionBy("key").orderBy("ts", "op_no").rowsBetween(Window.unboundedPreceding, -1)
    value = F.struct("kind", "s", "n")
    before = ops.withColumn("_before", F.last(F.when(F.col("op") == "Write", value), ignorenulls=True).over(order))
    near = F.abs(F.col("n") - F.col("_before.n")) <= NUMBER_TOLERANCE
    same = (F.col("kind") == F.col("_before.kind")) & F.when(F.col("kind") == "N", near).otherwise(F.col("s").eqNullSafe(F.col("_before.s")))
    return before.where((F.col("op") == "Read") & ~F.coalesce(same, F.lit(False))).select("ts", "op_no", "key")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two stores that the other one lacks, with side 'left' or 'right'."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def rejected_writes(log: DataFrame) -> DataFrame:
    """Writes that a store would have refused as they came: (key, seq, ts, reason).

    The log has (key, seq, ts, op) with op 'Read' or 'Write' in order of arrival
    seq. A write is refused if a later time has read or written the key before.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = log.withColumn("_read", F.max(F.when(F.col("op") == "Read", F.col("ts"))).over(before)).withColumn("_written", F.max(F.when(F.col("op") == "Write", F.col("ts"))).over(before))
    reason = F.when(F.col("_read") > F.col("ts"), "read later").when(F.col("_written") > F.col("ts"), "written later")
    return seen.where("op = 'Write'").withColumn("reason", reason).where("reason IS NOT NULL").select("key", "seq", "ts", "reason")


def phantom_inserts(keys: DataFrame, inserts: DataFrame) -> DataFrame:
    """Inserts (key, ts) of new keys next to a key (key, last_read) that a later time has read: (key, ts).

    An insert of a key that is there already is none of a new key. Keys and inserts
    are sorted together range by range; what a range's first insert has before it
    and its last one behind it comes from the nearest other range with a key, by a
    table of one row a range.
    """
    both = keys.groupBy("key").agg(F.max("last_read").alias("last_read")).select("key", F.struct("last_read").alias("there"), F.lit(None).cast("long").alias("ts"))
    both = both.unionByName(inserts.select("key", F.lit(None).cast("struct<last_read:long>").alias("there"), "ts").distinct())
    ranged = written(both.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ranges")
    edges = ranged.where("there IS NOT NULL").groupBy("part").agg(F.min_by("there", "key").alias("low"), F.max_by("there", "key").alias("high")).collect()  # a row a range
    parts = sorted({r[0] for r in ranged.select("part").distinct().collect()})
    rows, held = [], sorted((r["part"], r["low"][0], r["high"][0]) for r in edges)
    for p in parts:
        below = [high for part, _, high in held if part < p]
        above = [low for part, low, _ in held if part > p]
        rows.append((p, below[-1] if below else None, above[0] if above else None))
    borders = keys.sparkSession.createDataFrame(rows, "part int, below long, above long")
    order = Window.partitionBy("part").orderBy("key")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy("part").orderBy(F.col("key").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a frame that ends with the range would be read again for each row
    same = Window.partitionBy("part", "key")
    near = (
        ranged.withColumn("known", F.max(F.col("there").isNotNull()).over(same))
        .withColumn("before", F.last("there", ignorenulls=True).over(back)).withColumn("after", F.last("there", ignorenulls=True).over(on))
        .where("ts IS NOT NULL AND NOT known").join(F.broadcast(borders), "part")
    )
    before = F.when(F.col("before").isNotNull(), F.col("before.last_read")).otherwise(F.col("below"))
    after = F.when(F.col("after").isNotNull(), F.col("after.last_read")).otherwise(F.col("above"))
    return near.where((before > F.col("ts")) | (after > F.col("ts"))).select("key", "ts")


def repeated_values(table: DataFrame, value_col: str = "value", key_col: str = "key") -> DataFrame:
    """(value, n, keys): values that a unique index over the table would refuse; no rows if it could be made."""
    return table.groupBy(F.col(value_col).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.col(key_col))).alias("keys")).where("n > 1")


def lookup(table: DataFrame, wanted: DataFrame, value_col: str = "value") -> DataFrame:
    """Rows of the table with one of the wanted values."""
    return table.join(wanted.select(F.col(value_col)).distinct(), value_col, "left_semi")


class Store:
    """A store of versions with transactions of one writer: begin, write, delete, commit or abort, and reads as of a time."""

    _SCHEMA = "key string, kind string, s string, n double, ts long, op int, txn_id long"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._clock = CLOCK_START
        self._status: dict[int, str] = {}
        self._at: dict[int, int] = {}
        self._rows: list[tuple] = []

    def now(self) -> int:
        self._clock += CLOCK_STEP
        return self._clock

    def begin(self, ts: int | None = None) -> int:
        txn = len(self._status) + 1
        self._status[txn], self._at[txn] = "P", self.now() if ts is None else ts
        return txn

    def write(self, txn: int, key: str, value: str | float | None) -> None:
        """A string, a number, or None to delete."""
        self._pending(txn)
        kind = "D" if value is None else "S" if isinstance(value, str) else "N"
        self._rows.append((key, kind, value if kind == "S" else None, float(value) if kind == "N" else None, self._at[txn], len(self._rows), txn))

    def _pending(self, txn: int) -> None:
        if self._status.get(txn) != "P":
            raise ValueError(f"transaction {txn} is not pending")

    def commit(self, txn: int) -> None:
        self._pending(txn)
        self._status[txn] = "C"

    def abort(self, txn: int) -> None:
        self._pending(txn)
        self._status[txn] = "A"

    def put(self, key: str, value: str | float | None) -> None:
        """A write in a transaction of its own."""
        txn = self.begin()
        self.write(txn, key, value)
        self.commit(txn)

    def load(self, rows: dict[str, str | float | None]) -> Store:
        for key, value in rows.items():
            self.put(key, value)
        return self

    def txns(self) -> DataFrame:
        return self.spark.createDataFrame([(t, self._at[t], s) for t, s in self._status.items()], "txn_id long, ts long, status string")

    def log(self) -> DataFrame:
        return self.spark.createDataFrame(self._rows, self._SCHEMA)

    def versions(self) -> DataFrame:
        return version_chain(committed(self.log(), self.txns()))

    def read(self, ts: int = 0) -> DataFrame:
        return snapshot(self.versions(), ts)

    def read_range(self, prefix: str, ts: int = 0) -> DataFrame:
        return snapshot_range(self.versions(), prefix, ts)

    def wal(self) -> DataFrame:
        """Committed transactions as records of a log."""
        writes = committed(self.log(), self.txns())
        op = F.struct("op", F.struct(F.lit("Write").alias("op"), "key", "kind", "s", "n").alias("w"))
        return writes.groupBy("txn_id", "ts").agg(F.array_sort(F.collect_list(op)).alias("o")).select(F.col("ts").alias("timestamp"), F.col("o.w").alias("ops"))
