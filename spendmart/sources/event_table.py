"""The stored event table: immutable files under a manifest, a ledger of batches, an index of keys."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendmart.operators.fold import KEY, compact, fold, fold_events, from_state, plain_column, whole
from spendmart.schemas import EVENT_COLUMNS
from spendmart.session import materialize

UNIT_ROWS = 1_000_000  # rows of a data file, about
RUN_ROWS = 1_000_000  # keys of an index file, about
LEVEL_BITS = 3  # a level of the index has eight times the files of the one above
LOOSE_FILES = 16  # files of the top level before they become one
LEVEL_RUNS = 4  # runs of a lower level that wait for the next merge of the level
UNIT = ["event_date", "depth", "slot"]
VALUES = [c for c in EVENT_COLUMNS if c not in KEY]

_MANIFEST = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("slot", T.LongType()),
        T.StructField("commit", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("job", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("arrival", T.LongType()),
    ]
)


def _entry(**values) -> Row:
    return Row(**{c: values.get(c) for c in _MANIFEST.fieldNames()})


def _slot(depth: Column) -> Column:
    """The slot of a key among 2**depth."""
    return F.pmod(F.xxhash64(*KEY), F.pow(F.lit(2), depth).cast("bigint"))


@dataclass(frozen=True)
class Snapshot:
    """A state of the table: nothing it names is ever changed or overwritten.

    An entry is about a hundred bytes and stands for a file of about a million rows, so the list of a table of a hundred
    terabytes is some tens of megabytes; it is held once, on the driver, as every reader of many files does.
    """

    version: int
    entries: tuple[Row, ...]

    def of(self, kind: str) -> list[Row]:
        return [e for e in self.entries if e.kind == kind]


class EventTable:
    """Upserted usage events under a path.

    **Files.** A data file holds the keys of one UTC date (that of the key's first writer, which never moves) in one of
    2**depth slots of their hash. A file is written once and never changed; a merge writes new files for the units that
    hold its keys, and a unit of more than about UNIT_ROWS rows is split, so files keep their size as the table grows.
    With `changes`, a row that a merge has changed holds what it was before in `was`, until it is written again.

    **Manifest.** A version of the table is one small file that names its data and index files. It appears under
    `manifest/version=N` by the one rename that ends its write: a reader sees the old state or the new one, a reader
    that is open keeps reading the files it was given, and a merge that is cut off anywhere leaves only files that no
    manifest names (`unreferenced` lists them; removing them is left to whoever runs the storage). One writer at a
    time; of two that publish the same version, the one with the smaller commit id counts and the other raises.

    **Ledger.** Merges are numbered in order of arrival. The manifest records which batch of which job had which
    number, so a batch that is retried after it was committed changes nothing, whatever came in between.

    **Key index.** Where a key is stored is looked up in levels of sorted runs: new keys form small files on top, those of
    a large batch a run on the level of its size; when a level is full, it is merged with the next, which has eight times as many slots. A batch reads the slots of its own
    keys on every level, not the keys of the table.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1, unit_rows: int = UNIT_ROWS, run_rows: int = RUN_ROWS, changes: bool = False):
        """buckets: the slots that a new date starts with, rounded up to a power of two. changes: merges record what they change."""
        self.spark, self.path = spark, path.rstrip("/")
        self.depth = max(0, buckets - 1).bit_length()
        self.unit_rows, self.run_rows, self.changes = unit_rows, run_rows, changes

    # ------------------------------------------------------------ versions

    def _versions(self) -> list[tuple[int, str]]:
        """(version, file) of all manifests, by listing alone."""
        try:
            files = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").inputFiles()
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted((int(f.split("/version=")[1].split("/")[0]), f) for f in files)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest state, or that of an earlier version."""
        found = [v for v, _ in self._versions()]
        if version is None:
            version = found[-1] if found else 0
        if version == 0:
            return Snapshot(0, ())
        if version not in found:
            raise ValueError(f"{self.path} has no version {version}")
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}")
        rows = rows.select("*", F.col("_metadata.file_path").alias("file")).collect()
        winner = min((e.commit, e.file) for e in rows if e.kind == "commit")[1]
        return Snapshot(version, tuple(_entry(**{c: e[c] for c in _MANIFEST.fieldNames()}) for e in rows if e.file == winner))

    def _publish(self, version: int, commit: str, entries: list[Row]) -> None:
        listed = self.spark.createDataFrame([*entries, _entry(kind="commit", commit=commit)], _MANIFEST)
        listed.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(f"{self.path}/manifest")
        if [v for v, _ in self._versions()].count(version) > 1 and self.snapshot(version).of("commit")[0].commit != commit:
            raise RuntimeError(f"another writer published version {version} of {self.path}; merge again")

    def _read(self, kind: str, entries: list[Row]) -> DataFrame | None:
        """The rows of the listed units, with their partition columns."""
        listed = [e for e in entries if e.commit is not None]  # an empty slot has no file
        if not listed:
            return None
        root = f"{self.path}/{kind}"
        day = lambda r: f"/event_date={r.event_date}" if kind == "data" else ""
        paths = [f"{root}/commit={r.commit}{day(r)}/depth={r.depth}/slot={r.slot}" for r in listed]
        return self.spark.read.option("basePath", root).parquet(*paths).withColumn("slot", F.col("slot").cast("bigint"))

    def _written(self, kind: str, commit: str, rows: DataFrame) -> list[Row]:
        """Writes new files, one per unit, and gives their manifest entries. The rows come dealt by unit, each unit in one task."""
        units = UNIT if kind == "data" else UNIT[1:]
        folder = f"{self.path}/{kind}/commit={commit}"
        rows.sortWithinPartitions(*units, *KEY).write.partitionBy(*units).parquet(folder, compression="zstd")
        counted = self.spark.read.parquet(folder).groupBy(*units).agg(F.count(F.lit(1)).alias("rows"))
        return [_entry(kind=kind, commit=commit, **r.asDict()) for r in counted.collect()]

    # ------------------------------------------------------------ merging

    def _known(self, snapshot: Snapshot, incoming: DataFrame) -> DataFrame | None:
        """(key, home) of stored keys, from the index slots that the incoming keys fall into."""
        entries = snapshot.of("index")
        depths = sorted({e.depth for e in entries})  # one a level
        if not depths:
            return None
        tried = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _slot(F.lit(d)).alias("slot")) for d in depths])).alias("w")
        wanted = {(r.depth, r.slot) for r in incoming.select(tried).select("w.*").distinct().collect()}  # slots, at most those there are
        runs = self._read("index", [e for e in entries if (e.depth, e.slot) in wanted])
        return None if runs is None else runs.select(*KEY, "home")

    def _placed(self, snapshot: Snapshot, incoming: DataFrame, known: DataFrame | None) -> DataFrame:
        """incoming with its unit (event_date, depth, slot) and whether the key is new; `known`: where stored keys are."""
        found = incoming.withColumn("home", F.lit(None).cast("date")) if known is None else incoming.join(known, KEY, "left")
        found = found.withColumn("fresh", F.col("home").isNull()).withColumn("event_date", F.coalesce("home", F.col("first.ts").cast("date"), F.lit("1970-01-01").cast("date")))
        found = found.drop("home")
        entries = snapshot.of("data")
        if not entries:
            return found.withColumn("depth", F.lit(self.depth)).withColumn("slot", _slot(F.col("depth")))
        depths: dict = {}
        for e in entries:
            depths.setdefault(e.event_date, set()).add(e.depth)
        dates = self.spark.createDataFrame([(d, sorted(x)) for d, x in depths.items()], "event_date date, depths array<int>")
        tried = found.join(dates, "event_date", "left").withColumn("depth", F.explode(F.coalesce("depths", F.array(F.lit(self.depth)))))
        tried = tried.withColumn("slot", _slot(F.col("depth")))
        if all(len(x) == 1 for x in depths.values()):
            return tried.drop("depths")
        # of the depths tried, one has the key's slot
        units = self.spark.createDataFrame([(e.event_date, e.depth, e.slot) for e in entries], "event_date date, depth int, slot bigint")
        stored = tried.filter("depths IS NOT NULL").join(units, UNIT, "left_semi")
        return stored.unionByName(tried.filter("depths IS NULL")).drop("depths")

    def _indexed(self, snapshot: Snapshot, commit: str, fresh: DataFrame, n: int) -> list[Row]:
        """The index entries after `n` new keys (key, home)."""
        entries = snapshot.of("index")
        if not n:
            return entries
        below, target, own = n, 0, 0
        while n > self.run_rows << (LEVEL_BITS * own):
            own += 1
        while True:
            below += sum(e.rows for e in entries if e.depth == LEVEL_BITS * target)
            if below <= self.run_rows << (LEVEL_BITS * target):
                break
            target += 1
        depth = LEVEL_BITS * target
        merged = [e for e in entries if e.depth <= depth]
        if target == 0 and len(merged) < LOOSE_FILES:
            merged = []  # one more loose file on top
        elif own > 0 and len({e.commit for e in entries if e.depth == LEVEL_BITS * own}) < LEVEL_RUNS:
            depth, merged = LEVEL_BITS * own, []  # a large batch is a run of its own: what is stored is not written again
        older = self._read("index", merged)
        rows = fresh if older is None else fresh.unionByName(older.select(*KEY, "home"))
        rows = rows.repartition(_slot(F.lit(depth))).withColumn("depth", F.lit(depth)).withColumn("slot", _slot(F.lit(depth)))
        return [e for e in entries if e not in merged] + self._written("index", commit, rows)

    def merge(self, events: DataFrame, position: Column, job: str | None = None, batch: int | None = None, costly: bool = True) -> bool:
        """Folds a batch in; false when the ledger already has this batch of this job.

        `position` orders rows inside the batch: a number, or a struct of two numbers. A row without a whole key cannot
        be found again and is left out; callers set such rows aside before. A merge without a job and batch number is
        one more arrival each time. With `changes`, `changes/commit=...` records the touched rows as they were and are.
        The keys of `events` are read before the rows: `costly` events are computed once and written out for that.
        """
        snapshot = self.snapshot()
        ledger = snapshot.of("ledger")
        if job is not None and any((e.job, e.batch) == (job, batch) for e in ledger):
            return False
        arrival = max((e.arrival for e in ledger), default=-1) + 1
        commit = uuid.uuid4().hex

        events = events.filter(F.forall(F.array(*KEY), lambda part: part.isNotNull()))
        kind = events.select(position.alias("p")).schema["p"].dataType
        parts = [position[name] for name in kind.fieldNames()] if isinstance(kind, T.StructType) else [position, F.lit(0)]
        numbers = [part.cast("bigint").alias(name) for part, name in zip(parts, ("_position", "_line"), strict=True)]
        arriving = events.select(*KEY, *VALUES, *numbers)
        if costly and snapshot.of("index"):
            arriving = materialize(arriving, "arriving", "zstd")
        known = self._known(snapshot, arriving.select(*KEY))
        # one shuffle, of plain rows: it serves the fold and the search for stored keys
        seq = F.struct(F.lit(arrival).cast("bigint").alias("arrival"), F.col("_position").alias("position"), F.col("_line").alias("line"))
        incoming = fold_events(arriving.repartition(*KEY), seq)
        state = [c for c in incoming.columns if c not in KEY]
        placed = materialize(compact(self._placed(snapshot, incoming, known), key=[*KEY, *UNIT, "fresh"]), "placed", "zstd")

        entries = {(e.event_date, e.depth, e.slot): e for e in snapshot.of("data")}
        days = {day for day, _, _ in entries}
        touched = placed.groupBy(*UNIT).agg(F.count_if("fresh").alias("fresh")).collect()  # the files this merge rewrites
        grown, old_files, n = [], [], 0
        for t in touched:
            before = entries.pop((t.event_date, t.depth, t.slot), None)
            rows, n = t.fresh + (before.rows if before else 0), n + t.fresh
            grown.append((t.event_date, t.depth, t.slot, t.depth + max(0, math.ceil(math.log2(max(1, rows) / self.unit_rows)))))
            old_files += [before] if before else []
        if touched:
            key = [*KEY, *UNIT]
            rows = placed.select(*key, *state, F.lit(False).alias("stored"))
            old = self._read("data", old_files)
            if old is not None:
                rows = compact(whole(old, key=key), key=key).select(*key, *state, F.lit(True).alias("stored")).unionByName(rows)
            units = self.spark.createDataFrame(grown, "event_date date, depth int, slot bigint, grown int")
            split = rows.join(units, UNIT).withColumn("depth", F.col("grown")).withColumn("slot", _slot(F.col("grown"))).drop("grown")
            # a key's rows, at most one stored and one new, meet in the task that writes their file
            met = whole(split.repartition(*UNIT), key=[*key, "stored"])
            key, also = [*UNIT, *KEY], []
            if self.changes:
                was = F.max(F.when(F.col("stored"), F.struct(*[plain_column(c).alias(c) for c in VALUES])))
                also = [F.when(~F.bool_and("stored"), was).alias("was")]
            for e in self._written("data", commit, compact(fold(met, key=key, also=also), key=key + ["was"] * self.changes)):
                entries[e.event_date, e.depth, e.slot] = e
            # every key of a known date has a slot: slots without a row are listed without a file
            slots = [(day, deeper, s) for day, depth, slot, deeper in grown for s in range(slot, 1 << deeper, 1 << depth)]
            theirs = {(t.event_date, t.depth, t.slot) for t in touched}
            slots += [(day, self.depth, s) for day in {t.event_date for t in touched} - days for s in range(1 << self.depth) if (day, self.depth, s) not in theirs]
            for unit in slots:
                entries.setdefault(unit, _entry(kind="data", rows=0, **dict(zip(UNIT, unit, strict=True))))
        if self.changes:
            self._record(commit, arrival, placed)
        fresh = placed.filter("fresh").select(*KEY, F.col("event_date").alias("home"))
        index = self._indexed(snapshot, commit, fresh, n)
        ledger = [e for e in ledger if e.job is not None] + [_entry(kind="ledger", job=job, batch=batch, arrival=arrival)]
        self._publish(snapshot.version + 1, commit, [*entries.values(), *index, *ledger])
        return True

    def _record(self, commit: str, arrival: int, placed: DataFrame) -> None:
        """The touched rows before and after the merge, as plain events with a sign, from the files it wrote.

        A row that this merge touched has its arrival as the last; what it was before is beside it.
        """
        try:
            written = self.spark.read.parquet(f"{self.path}/data/commit={commit}")
        except AnalysisException:
            written = placed  # nothing arrived, nothing was written
        rows = from_state(written.filter(F.col("last.seq.arrival") == arrival)).select(*EVENT_COLUMNS, F.lit(1).alias("sign"))
        if "was" in written.columns:
            before = written.filter("was IS NOT NULL").select(*KEY, "was.*").select(*EVENT_COLUMNS, F.lit(-1).alias("sign"))
            rows = rows.unionByName(before)
        rows.write.parquet(f"{self.path}/changes/commit={commit}", compression="zstd")

    # ------------------------------------------------------------ reading

    def events(self, version: int | None = None) -> DataFrame:
        """The table as plain events, with `event_date` left in for partition pruning."""
        snapshot = self.snapshot(version)
        stored = self._read("data", snapshot.of("data"))
        if stored is None:
            raise FileNotFoundError(f"nothing has been merged into {self.path} yet")
        return from_state(stored, key=[*KEY, "event_date"]).select(*EVENT_COLUMNS, "event_date")

    def commits(self) -> list[tuple[int, str]]:
        """(version, commit) of all merges, in order."""
        return [(v, self.snapshot(v).of("commit")[0].commit) for v, _ in sorted(dict(self._versions()).items())]

    def unreferenced(self) -> DataFrame:
        """(kind, file): data and index files that the newest version does not name."""
        snapshot, found = self.snapshot(), []
        for kind in ("data", "index"):
            try:
                files = self.spark.read.parquet(f"{self.path}/{kind}").inputFiles()
            except AnalysisException:
                continue
            named = self._read(kind, snapshot.of(kind))
            found += [(kind, f) for f in sorted(set(files) - set(named.inputFiles() if named is not None else []))]
        return self.spark.createDataFrame(found, "kind string, file string")


def write_events(events: DataFrame, path: str, files_per_day: int = 8) -> None:
    """The analytics layout: one partition per UTC date, rows near their session.

    A day is spread over `files_per_day` tasks by session, so no single day is one task's work.
    """
    spread = F.pmod(F.xxhash64("session_id", "request_id"), F.lit(files_per_day))
    (
        events.withColumn("event_date", F.col("ts").cast("date"))
        .repartition("event_date", spread)
        .sortWithinPartitions("event_date", "session_id", "ts")
        .write.mode("overwrite")
        .partitionBy("event_date")
        .parquet(path)
    )


def duplicate_keys(events: DataFrame) -> DataFrame:
    """Keys stored more than once; must be empty."""
    return events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
