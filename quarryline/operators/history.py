"""Versions of changing entities with their periods of validity, kept current by rebuilding affected chains.

A store holds the raw observations and, by bucket of entities, the built chains. An update (new, late or
corrected observations) is appended to the raw data; then only the raw rows of the entities it touches are read, all their intervals are
rebuilt, and the buckets that hold them are written anew. Numbered manifests name the current files; the next number is taken by
one rename that fails if another update took it, so a reader sees all of an update's chains or none, a failed update changes nothing, and of two updates at once
one fails. The first update chooses the number of buckets by its size and the manifest keeps it; a bucket that has grown is written by several tasks, rows sorted by entity.

Defined results: rows without entity, time or, unless a deletion, digest tell nothing; of several rows for one entity and time the last
received counts (then the greatest row id; null receipt times first); repeated rows change nothing; entities seen only as deleted have no version; an empty input gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarryline.session import checkpoint_root

OBSERVATION = "entity long, seen_at timestamp, received_at timestamp, row_id long, digest string, gone boolean"
RAW = OBSERVATION + ", bucket int"
CHAIN = "entity long, version long, digest string, valid_from timestamp, valid_to timestamp, bucket int"


def bare_digest(c: Column | str) -> Column:
    """Lower-case hex digest without blanks and algorithm prefix; null when nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), "^sha-?256:\\s*", ""), F.lit(""))


def observations(snapshots: DataFrame) -> DataFrame:
    """Registry snapshots as observations; only indexed and deleted rows tell something."""
    gone = F.col("status") == "deleted"
    return snapshots.where("status in ('indexed', 'deleted') and doc_id is not null and snapshot_at is not null").select(
        F.col("doc_id").cast("long").alias("entity"), F.col("snapshot_at").alias("seen_at"), "received_at", F.col("snap_id").cast("long").alias("row_id"), F.when(~gone, bare_digest("doc_hash")).alias("digest"), gone.alias("gone")
    ).where("gone or digest is not null")


def chains(obs: DataFrame) -> DataFrame:
    """(entity, version, digest, valid_from, valid_to) of observations; valid_to is null while open."""
    last = obs.groupBy("entity", "seen_at").agg(F.max(F.struct("received_at", "row_id", F.col("gone").alias("gone"), "digest")).alias("o")).select("entity", "seen_at", "o.digest", "o.gone")
    by = W.partitionBy("entity").orderBy("seen_at")
    state = F.when(F.col("gone"), F.lit("")).otherwise(F.col("digest"))
    turns = last.withColumn("state", state).withColumn("before", F.lag("state").over(by)).where("before is null or before <> state")
    spans = turns.withColumn("valid_to", F.lead("seen_at").over(by)).where("not gone")
    return spans.select("entity", F.row_number().over(by).cast("long").alias("version"), "digest", F.col("seen_at").alias("valid_from"), "valid_to")


#: Observations to a bucket when a store begins, and to a task that writes one; least number of buckets.
BUCKET_ROWS, TASK_ROWS, LEAST_BUCKETS = 250_000, 1_000_000, 8


class HistoryStore:
    """Raw observations and current chains under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None) -> None:
        self.spark, self.root, self.wanted = spark, root.rstrip("/"), buckets
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def manifest(self) -> dict:
        """{"version", "buckets_of", "rows", "raw": [folders], "buckets": {bucket: folder}} of the last finished update."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets_of": None, "rows": 0, "raw": [], "buckets": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{versions[-1]:09d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        new = self._path(f"{self.root}/manifests/.new-{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # without the option to overwrite
            context.rename(new, self._path(f"{self.root}/manifests/{manifest['version']:09d}"), self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(new, False)
            raise RuntimeError(f"another update took version {manifest['version']}; apply again") from e

    def vacuum(self) -> None:
        """Delete chains that the last manifest does not name, and the manifests before it; not while readers of older ones are at work."""
        last, versions = self.manifest(), self._versions()
        for v in versions[:-1]:
            self._fs.delete(self._path(f"{self.root}/manifests/{v:09d}"), False)
        at = self._path(f"{self.root}/chains")
        live = {p.rsplit("/", 2)[-2] + "/" + p.rsplit("/", 1)[-1] for p in last["buckets"].values()}
        for update in self._fs.listStatus(at) if self._fs.exists(at) else []:
            for part in self._fs.listStatus(update.getPath()):
                if part.isDirectory() and f"{update.getPath().getName()}/{part.getPath().getName()}" not in live:
                    self._fs.delete(part.getPath(), True)

    def _read(self, kind: str, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = [f.name for f in T._parse_datatype_string(schema).fields]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths).select(*names)

    def raw(self) -> DataFrame:
        return self._read("raw", self.manifest()["raw"], RAW)

    def history(self) -> DataFrame:
        return self._read("chains", sorted(self.manifest()["buckets"].values()), CHAIN).drop("bucket")

    def apply(self, updates: DataFrame) -> None:
        """Take in observations and rebuild the chains of the entities they touch."""
        old, name = self.manifest(), uuid.uuid4().hex
        n = old["buckets_of"]
        if n is None:
            n = self.wanted or max(LEAST_BUCKETS, -(-updates.count() // BUCKET_ROWS))
        elif self.wanted not in (None, n):
            raise ValueError(f"the store has {n} buckets, not {self.wanted}")
        number = F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int")
        tasks = max(1, old["rows"] // (n * TASK_ROWS) + 1)
        spread = lambda df: df.repartition("bucket", F.pmod(F.xxhash64(F.lit(1), "entity"), F.lit(tasks))).sortWithinPartitions("bucket", "entity")
        delta = f"{self.root}/raw/delta={name}"
        spread(updates.withColumn("bucket", number)).write.partitionBy("bucket").parquet(delta)
        fresh = self._read("raw", [delta], RAW)
        # the touched buckets: numbers below ``n``; partition pruning then reads only their raw rows and chains
        seen = fresh.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        hit, raw, buckets = sorted(r["bucket"] for r in seen), old["raw"] + [delta], old["buckets"]
        if hit:
            touched = fresh.select("entity", "bucket").distinct()
            every = self._read("raw", raw, RAW).where(F.col("bucket").isin(hit))
            rebuilt = chains(every.join(touched, ["entity", "bucket"], "left_semi")).withColumn("bucket", number)
            kept = self._read("chains", [old["buckets"][str(b)] for b in hit if str(b) in old["buckets"]], CHAIN).join(touched, ["entity", "bucket"], "left_anti")
            rows = rebuilt.unionByName(kept.select(*rebuilt.columns)).select(*(F.col(f.name) for f in T._parse_datatype_string(CHAIN).fields))
            chain_root = f"{self.root}/chains/update={name}"
            spread(rows).withColumn("b", F.col("bucket")).write.partitionBy("b").parquet(chain_root)
            written = {b for b in hit if self._fs.exists(self._path(f"{chain_root}/b={b}"))}
            buckets = {k: v for k, v in old["buckets"].items() if int(k) not in hit} | {str(b): f"{chain_root}/b={b}" for b in written}
        self._publish({"version": old["version"] + 1, "buckets_of": n, "rows": old["rows"] + sum(r["n"] for r in seen), "raw": raw, "buckets": buckets})


def history_from_deliveries(snapshots: DataFrame, late_after: str = "1 day", root: str | None = None) -> DataFrame:
    """Chains of registry snapshots: first the rows received in time, then the late and corrected ones as an update."""
    spark = snapshots.sparkSession
    obs = observations(snapshots)
    late = F.coalesce(F.col("received_at") > F.col("seen_at") + F.expr(f"interval {late_after}"), F.lit(False))
    store = HistoryStore(spark, root or f"{checkpoint_root(spark)}/quarryline-history-{uuid.uuid4().hex}")
    store.apply(obs.where(~late))
    store.apply(obs.where(late))
    return store.history()


def p3_found(snapshots: DataFrame) -> DataFrame:
    """One row per version of each document, times as text."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return history_from_deliveries(snapshots).select(
        F.col("entity").alias("doc_id"), "version", F.col("digest").alias("doc_hash"), text("valid_from").alias("effective_from"), F.coalesce(text("valid_to"), F.lit("open")).alias("effective_to")
    )


P3_SQL = """
with obs as (
  select doc_id, snapshot_at, received_at, snap_id, status,
         case when status = 'indexed' then nullif(regexp_replace(lower(trim(doc_hash)), '^sha-?256:\\s*', ''), '') end as digest
  from registry_snapshots where status in ('indexed', 'deleted') and doc_id is not null and snapshot_at is not null
), last as (
  select *, case when status = 'deleted' then '' else digest end as state from obs where status = 'deleted' or digest is not null
  qualify row_number() over (partition by doc_id, snapshot_at order by received_at desc nulls last, snap_id desc) = 1
), marked as (
  select *, lag(state) over (partition by doc_id order by snapshot_at) as before from last
), turns as (
  select *, lead(snapshot_at) over (partition by doc_id order by snapshot_at) as until from marked where before is null or before <> state
)
select doc_id, row_number() over (partition by doc_id order by snapshot_at) as version, state as doc_hash,
       strftime(snapshot_at, '%Y-%m-%d %H:%M:%S') as effective_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S'), 'open') as effective_to
from turns where state <> ''
"""
