"""The article table on Parquet (SNK-1..7).

Layout under the table path::

    gen=000000001/rows/batch=<n>/*.parquet    articles appended by batch n
    gen=000000001/changes/batch=<n>/*.parquet articles of the n-th upsert
    gen=000000001/sent/batch=<n>/*.parquet    delivery marks (id, sent_at) of batch n
    gen=000000001/outbox/batch=<n>/*.parquet  messages selected by batch n
    gen=000000001/<rows|changes>_keys/batch=<n>/*.parquet  Bloom filter of a batch's keys

A batch counts once Spark's ``_SUCCESS`` file is there, so a half-written one is never
read, and writing a batch again replaces it (replay). Appends, upserts and delivery marks cost
what they add, not the size of the table: a read takes the last change of each id and the last
mark. ``compact`` folds everything into one batch of a new generation.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgrist.functions import bloom
from newsgrist.functions.keys import having, stored_values
from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import BROADCAST_KEYS, fits
from newsgrist.functions.times import parse_iso
from newsgrist.schema import STORE_COLUMNS, STORE_REQUIRED, STORE_SCHEMA, conform


KEYS = ["id", "url", "content_hash"]
_CHANGE_SCHEMA = f"{STORE_SCHEMA}, marks_upto bigint"


class ConstraintError(Exception):
    """A write would break a key or not-null rule; nothing was written."""


def fill_defaults(articles: DataFrame, run_ts: datetime, *extra: str) -> DataFrame:
    """Missing id, ``discovered_at`` and ``created_at``; columns in store order, then ``extra``.

    The id is the head of the content hash, so a replay gives the same one.
    """
    rows = conform(articles, STORE_COLUMNS, STORE_SCHEMA, *extra)
    now = F.lit(run_ts).cast("timestamp")
    by_content = F.substring(F.coalesce("content_hash", F.sha2(F.col("url"), 256)), 1, 32)
    return rows.withColumns(
        {
            "id": F.coalesce(F.nullif(F.col("id"), F.lit("")), by_content),
            "categories": F.coalesce("categories", F.array().cast("array<string>")),
            "relevance_score": F.coalesce("relevance_score", F.lit(0.0)),
            "sent": F.coalesce("sent", F.lit(False)),
            "discovered_at": F.coalesce("discovered_at", now),
            "created_at": F.coalesce("created_at", now),
        }
    )


def null_violations(rows: DataFrame) -> DataFrame:
    """(rule, key, n): required columns with nulls, in one pass."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in STORE_REQUIRED])
    pairs = F.array(
        *[F.struct(F.lit(f"{c} not null").alias("rule"), F.col(c).alias("n")) for c in STORE_REQUIRED]
    )
    return counts.select(F.inline(pairs)).where("n > 0").select(
        "rule", F.lit(None).cast("string").alias("key"), "n"
    )


def key_violations(rows: DataFrame) -> DataFrame:
    """(rule, key, n): ids and urls that occur more than once (counts combine map-side)."""
    repeated = [
        rows.where(F.col(c).isNotNull())
        .groupBy(F.col(c).alias("key"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(F.lit(f"{c} unique").alias("rule"), "key", "n")
        for c in ("id", "url")
    ]
    return repeated[0].unionByName(repeated[1])


def constraint_violations(rows: DataFrame) -> DataFrame:
    """SNK-5 over a whole table."""
    return key_violations(rows).unionByName(null_violations(rows))


def append_violations(store: DataFrame, batch: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """SNK-5 for an append: the batch in itself, and its keys against the store.

    Only the store's two key columns are read, and matched against the keys of the batch that
    its ``filters`` let through.
    """
    parts = [constraint_violations(batch)]
    for c in ("id", "url"):
        counts = batch.groupBy(c).agg((F.count("*") + 1).alias("n"))
        taken = counts.join(stored_values(store, batch, c, filters), c, "left_semi")
        parts.append(taken.select(F.lit(f"{c} unique").alias("rule"), F.col(c).alias("key"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def last_per_id(batch: DataFrame, order: str) -> DataFrame:
    """The last row of each id in ``order``, found on (id, order) only, so a much repeated id
    is no hot group."""
    last = batch.groupBy("id").agg(F.max(order).alias(order))
    return batch.join(last, ["id", order], "left_semi")


def upserted(target: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """SNK-4: ``target`` with the rows of ``batch`` replaced or added by id.

    The last row per id in ``order`` wins; ``created_at`` of an existing row stays.
    """
    fresh = last_per_id(batch, order).select(*target.columns)
    born = target.select("id", F.col("created_at").alias("_born"))
    replaced = (
        fresh.join(born, "id", "left")
        .withColumn("created_at", F.coalesce("_born", "created_at"))
        .select(*target.columns)
    )
    return target.join(fresh.select("id"), "id", "left_anti").unionByName(replaced)


def with_delivery(store: DataFrame, results: DataFrame) -> DataFrame:
    """SNK-6, OUT-5: rows with an ``ok`` result become sent; a later result overwrites."""
    marks = results.where("ok").groupBy("id").agg(F.max("sent_at").alias("_mark"))
    return (
        store.join(marks, "id", "left")
        .withColumns(
            {
                "sent": F.col("sent") | F.col("_mark").isNotNull(),
                "sent_at": F.coalesce("_mark", "sent_at"),
            }
        )
        .select(*store.columns)
    )


def unknown_deliveries(store: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose id is not stored."""
    return results.join(store.select("id"), "id", "left_anti")


def _iso_text(ts: Column) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.when(
        F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")
    ).otherwise("")
    return F.concat(whole, micros, F.lit("+00:00"))


def encode_rows(store: DataFrame) -> DataFrame:
    """SNK-7 export: ISO text times, JSON categories, 0/1 flag."""
    times = {c: _iso_text(F.col(c)) for c in ("published_at", "discovered_at", "sent_at", "created_at")}
    return store.withColumns(
        {**times, "categories": F.to_json("categories"), "sent": F.col("sent").cast("int")}
    )


def decode_rows(encoded: DataFrame, run_ts: datetime) -> DataFrame:
    """SNK-7 import: bad JSON categories become [], bad times null, a bad
    ``discovered_at`` the time of the run."""
    found = F.nullif(F.col("discovered_at"), F.lit(""))
    names = F.from_json("categories", "array<string>")
    return encoded.withColumns(
        {
            "published_at": parse_iso(F.col("published_at")),
            "sent_at": parse_iso(F.col("sent_at")),
            "created_at": parse_iso(F.col("created_at")),
            "discovered_at": F.when(
                found.isNotNull(), F.coalesce(parse_iso(found), F.lit(run_ts).cast("timestamp"))
            ),
            "categories": F.coalesce(
                F.transform(names, lambda c: F.coalesce(c, F.lit("None"))),
                F.array().cast("array<string>"),
            ),
            "relevance_score": F.col("relevance_score").cast("double"),
            "sent": F.col("sent") != 0,
        }
    )


class ArticleStore:
    """Reads and writes the table at ``path`` on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _children(self, path: str) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(folder))

    def _complete(self, path: str) -> list[str]:
        """Folders of the batches that were written to the end: one listing for all."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(f"{path}/{s.getPath().getParent().getName()}" for s in found or [])

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _generation(self) -> int:
        ready = [
            int(name[4:])
            for name in self._children(self.path)
            if name.startswith("gen=") and self._complete(f"{self.path}/{name}/rows")
        ]
        return max(ready, default=0)

    def _folder(self, generation: int, part: str) -> str:
        return f"{self.path}/gen={generation:09d}/{part}"

    def _batch(self, generation: int, part: str, batch_id: int) -> str:
        return f"{self._folder(generation, part)}/batch={batch_id:012d}"

    def _write(self, rows: DataFrame, generation: int, part: str, batch_id: int) -> None:
        # Even file sizes whatever the partitioning of the plan.
        rows.hint("rebalance").write.mode("overwrite").parquet(self._batch(generation, part, batch_id))

    def _write_keyed(self, rows: DataFrame, generation: int, part: str, batch_id: int) -> None:
        """A batch and the filter of its keys. The filter of a batch written before goes first:
        a batch without one gets it at the next look, but never an old one."""
        self._delete(self._batch(generation, f"{part}_keys", batch_id))
        self._write(rows, generation, part, batch_id)
        self._write_filter(generation, part, batch_id)

    def _write_filter(self, generation: int, part: str, batch_id: int) -> None:
        rows = self.spark.read.schema(STORE_SCHEMA).parquet(self._batch(generation, part, batch_id))
        paths = [p for x in ("rows", "changes") for p in self._complete(self._folder(generation, x))]
        # Of a column-less read only the footers are looked at.
        stored = self.spark.read.schema(STORE_SCHEMA).parquet(*paths).count()
        self._write(bloom.build(rows, KEYS, stored), generation, f"{part}_keys", batch_id)

    def key_filters(self, *, without_batch: int | None = None) -> DataFrame:
        """The Bloom filters of all stored ids, urls and hashes, one of each batch."""
        generation, paths = self._generation(), []
        for part in ("rows", "changes"):
            done = set(self._complete(self._folder(generation, f"{part}_keys")))
            for batch in self._complete(self._folder(generation, part)):
                number = int(batch.rsplit("=", 1)[1])
                if part == "rows" and number == without_batch:
                    continue
                path = self._batch(generation, f"{part}_keys", number)
                if path not in done:
                    self._write_filter(generation, part, number)
                paths.append(path)
        if not paths:
            return self.spark.createDataFrame([], bloom.SCHEMA)
        return self.spark.read.schema(bloom.SCHEMA).parquet(*paths)

    def create(self) -> ArticleStore:
        """SNK-1: an empty table if there is none."""
        if self._generation() == 0:
            self._write(self.spark.createDataFrame([], STORE_SCHEMA), 1, "rows", 0)
        return self

    def _read_part(self, part: str, schema: str, without: int | None) -> DataFrame:
        folder = self._folder(self._generation(), part)
        batches = [p for p in self._complete(folder) if int(p.rsplit("=", 1)[1]) != without]
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        reader = self.spark.read.schema(f"{schema}, batch bigint").option("basePath", folder)
        return reader.parquet(*batches)

    def read(self, *, without_batch: int | None = None) -> DataFrame:
        """The table as of now; ``without_batch`` leaves one batch out (for its replay)."""
        rows = self._read_part("rows", STORE_SCHEMA, without_batch).drop("batch")
        rows = rows.withColumn("marks_upto", F.lit(-1).cast("bigint"))
        if self._complete(self._folder(self._generation(), "changes")):
            # Changes come by the batch; while they fit, articles are not shuffled for them.
            changes = last_per_id(self._read_part("changes", _CHANGE_SCHEMA, None), "batch").drop("batch")
            changed = changes.select("id")
            if fits(changed, BROADCAST_KEYS):
                changed = F.broadcast(changed)
            rows = rows.join(changed, "id", "left_anti").unionByName(changes)
        marks = self._read_part("sent", "id string, sent_at timestamp", None)
        latest = marks.groupBy("id").agg(F.max_by("sent_at", "batch").alias("_mark"), F.max("batch").alias("_marked"))
        # So do marks. Those from before a change of the row are part of what it replaced.
        if fits(marks, BROADCAST_KEYS):
            latest = F.broadcast(latest)
        return (
            rows.join(latest, "id", "left")
            .withColumn("_mark", F.when(F.col("_marked") > F.col("marks_upto"), F.col("_mark")))
            .withColumns(
                {
                    "sent": F.col("sent") | F.col("_mark").isNotNull(),
                    "sent_at": F.coalesce("_mark", "sent_at"),
                }
            )
            .select(*STORE_COLUMNS)
        )

    def append(self, articles: DataFrame, batch_id: int, run_ts: datetime | None = None) -> None:
        """SNK-2, SNK-3: all rows of the batch or, on any clash, none."""
        rows = fill_defaults(articles, run_ts or datetime.now(timezone.utc))
        stored = self.create().read(without_batch=batch_id)
        self._refuse(append_violations(stored, rows, self.key_filters(without_batch=batch_id)))
        self._write_keyed(rows, self._generation(), "rows", batch_id)

    def _numbers(self, part: str) -> list[int]:
        return [int(p.rsplit("=", 1)[1]) for p in self._complete(self._folder(self._generation(), part))]

    def upsert(self, articles: DataFrame, order: str = "seq", run_ts: datetime | None = None) -> None:
        """SNK-4: insert or replace by id. Writes the rows of the batch, the last of each id."""
        generation = self.create()._generation()
        rows = fill_defaults(articles, run_ts or datetime.now(timezone.utc), order)
        rows = cut_lineage(last_per_id(rows, order).drop(order))
        stored, filters = self.read(), self.key_filters()
        same_url = having(stored.select(*STORE_COLUMNS), rows, "url", filters)
        touched = same_url.join(rows.select("id"), "id", "left_anti").unionByName(rows)
        self._refuse(constraint_violations(touched))
        born = having(stored.select("id", F.col("created_at").alias("_born")), rows, "id", filters)
        changes = rows.join(born, "id", "left").withColumns(
            {
                "created_at": F.coalesce("_born", "created_at"),
                "marks_upto": F.lit(max(self._numbers("sent"), default=-1)).cast("bigint"),
            }
        )
        number = max(self._numbers("changes"), default=0) + 1
        self._write_keyed(changes.select(*STORE_COLUMNS, "marks_upto"), generation, "changes", number)

    def compact(self) -> None:
        """Folds appends, changes and marks into one batch of a new generation. Batches run
        before are part of it and are not to be run again."""
        generation = self.create()._generation()
        rows = self.read()
        for path in self._complete(self._folder(generation, "outbox")):
            box = self.spark.read.parquet(path)
            self._write(box, generation + 1, "outbox", int(path.rsplit("=", 1)[1]))
        self._write_keyed(rows, generation + 1, "rows", 0)

    def mark_sent(self, results: DataFrame, batch_id: int) -> None:
        """SNK-6: records successful deliveries of stored ids. A batch that is run again
        adds to its own marks."""
        known = stored_values(self.read(), results, "id", self.key_filters())
        marks = results.where("ok").join(known, "id", "left_semi")
        marks = marks.select("id", "sent_at")
        folder = self._folder(self._generation(), "sent")
        earlier = f"{folder}/batch={batch_id:012d}"
        if earlier in self._complete(folder):
            old = self.spark.read.schema(marks.schema).parquet(earlier)
            marks = cut_lineage(marks.unionByName(old.join(marks.select("id"), "id", "left_anti")))
        self._write(marks, self._generation(), "sent", batch_id)

    def save_outbox(self, outbox: DataFrame, batch_id: int) -> DataFrame:
        """OUT-3: the outbox of a batch, written once; a replay gets the first one back."""
        folder = self._folder(self._generation(), "outbox")
        target = f"{folder}/batch={batch_id:012d}"
        if target not in self._complete(folder):
            self._write(outbox, self._generation(), "outbox", batch_id)
        return self.spark.read.schema(outbox.schema).parquet(target)

    @staticmethod
    def _refuse(violations: DataFrame) -> None:
        first = violations.limit(3).collect()
        if first:
            raise ConstraintError("; ".join(f"{v.rule}: {v.key} ({v.n})" for v in first))
