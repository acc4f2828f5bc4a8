"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed by them and sorted, with the number of
documents and the largest document id of each. A new batch is aggregated and
merged with the runs: the lines that no run holds (its anti-join with them) are
its first ones, so a line is a first one in one run only; the others raise the
counts of lines that are held. Both are written as a run of level 0. Once a level
has ``fanout`` runs they are compacted into one run of the next level, so a line
is rewritten a logarithmic number of times however many batches there are.
Buckets meet without a shuffle, and as they are sorted, without a sort.

A line is repeated where its count with its raises reaches the bound. Repeated
lines are joined with the hashes of all lines, and each document loses those of
which another one is the last.

Texts are read twice, once for the hashes and once for what is left. Only hashes
are shuffled, 128 bits of each line, and they are pre-aggregated, so a line that
a third of all documents share costs one row a task. Everything runs as DataFrame
expressions.
"""

from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, checkpoint, lower_ascii, remove_folder, shared_folder

#: Least code points of a key that counts.
LEAST_LENGTH = 20
#: A key must be in at least so many documents.
LEAST_DOCS = 3
#: Batches in which the registered query feeds its table, and runs of a level that are merged into one.
BATCHES = 4
FANOUT = 4


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.trim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc, h1, h2: the distinct counting keys of each row."""
    keys = F.filter(F.transform(_lines(F.col(text_col)), line_key), lambda k: F.char_length(k) >= least_length)
    exploded = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(keys)).alias("k"))
    return exploded.select("doc", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))


@contextmanager
def _buckets_in_order(spark: SparkSession):
    """Lets scans of sorted buckets of one file each count as sorted."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LineRuns:
    """The runs below ``path`` (a shared folder), by level; each is an external table there."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("a level needs at least two runs to be merged")
        self.spark, self.path, self.fanout = spark, path or shared_folder(spark, "line-runs"), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._name, self._made = f"line_run_{uuid4().hex}", 0

    def _write(self, level: int, lines: DataFrame) -> None:
        """h1, h2, n_docs, last and raises (false: a first line), one file a bucket for either."""
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"{self._name}_{self._made}"
        self._made += 1
        # lines come dealt by their hashes, so a bucket is one file
        writer = lines.write.partitionBy("raises").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", self._where(level, name)).saveAsTable(name)
        self.levels[level].append(name)

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _where(self, level: int, name: str) -> str:
        return f"{self.path}/level={level}/run={name.rsplit('_', 1)[1]}"

    def _files(self, level: int) -> DataFrame:
        """The rows of a level's runs, read as plain files: Spark 4.1 takes a union of bucketed scans for grouped, which it isn't."""
        return self._union([self.spark.read.schema(self.spark.table(r).schema).parquet(self._where(level, r)) for r in self.levels[level]])

    def add(self, hashes: DataFrame) -> None:
        """Add a batch (doc, h1, h2; a document's repeats taken out) as a run and compact full levels."""
        batch = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last")).withColumn("raises", F.lit(False))
        with _buckets_in_order(self.spark):
            for run in self._runs():
                held = run.where(~F.col("raises")).select("h1", "h2", F.lit(True).alias("_held")).hint("merge")
                batch = batch.join(held, ["h1", "h2"], "left").withColumn("raises", F.col("raises") | F.col("_held").isNotNull()).drop("_held")
            self._write(0, batch)
            level = 0
            while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                runs = self.levels[level]
                # raises of lines that are first in a run of another level stay raises
                totals = (F.sum("n_docs").alias("n_docs"), F.max("last").alias("last"), F.bool_and("raises").alias("raises"))
                self._write(level + 1, self._files(level).groupBy("h1", "h2").agg(*totals))
                self.levels[level] = []
                self._drop(runs)
                for r in runs:
                    remove_folder(self.spark, self._where(level, r))
                level += 1

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def lines(self) -> DataFrame | None:
        """h1, h2, n_docs, last over all runs; None before the first batch. Only raises are shuffled: first lines stay in their buckets."""
        runs = self._runs()
        if not runs:
            return None
        found = [r.where(~F.col("raises")).select("h1", "h2", "n_docs", "last") for r in runs]
        if len(runs) == 1:
            return found[0]
        raises = self._union([self._files(k).where("raises") for k, names in enumerate(self.levels) if names])
        more = raises.groupBy("h1", "h2").agg(F.sum("n_docs").alias("_n"), F.max("last").alias("_last")).hint("merge")
        total = (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs")
        return self._union([f.join(more, ["h1", "h2"], "left").select("h1", "h2", total, F.greatest("last", "_last").alias("last")) for f in found])

    def new(self, hashes: DataFrame) -> DataFrame:
        """Those of ``hashes`` that no run holds yet (first seen wins), by merge anti-joins."""
        for run in self._runs():
            hashes = hashes.join(run.where(~F.col("raises")).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def remove(self) -> None:
        self._drop([r for level in self.levels for r in level])
        self.levels = []
        remove_folder(self.spark, self.path)


def lost_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc and the hashes (h1) of the lines that it loses, for documents that lose any."""
    spark = docs.sparkSession
    path = shared_folder(spark, "line-hashes")
    part = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch")
    line_hashes(docs, id_col, text_col).select("doc", "h1", "h2", part).write.partitionBy("batch").parquet(path)
    kind = docs.schema[id_col].dataType.simpleString()
    stored = spark.read.schema(f"doc {kind}, h1 bigint, h2 bigint, batch int").parquet(path)
    runs = LineRuns(spark, fanout=fanout)
    for k in range(batches):
        runs.add(stored.where(F.col("batch") == k).select("doc", "h1", "h2"))
    with _buckets_in_order(spark):
        repeated = checkpoint(runs.lines().where(F.col("n_docs") >= least_docs).select("h1", "h2", "last"))
    lost = stored.join(repeated, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("last")))
    found = checkpoint(lost.groupBy("doc").agg(F.collect_set("h1").alias("hashes")))
    runs.remove()
    remove_folder(spark, path)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the text deduplicated, and n_lines and n_dropped added (replacing columns of these names).

    A key of at least 20 code points in at least ``least_docs`` documents loses
    all its lines except in the largest id that holds it. Each row counts as a
    document; rows that share an id share its fate. A null or empty text is one
    empty line and becomes an empty text. A null id counts as a document and
    never as the largest, unless all holders are null: then they keep the line.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lost = lost_lines(docs, id_col, text_col, least_docs, batches, fanout)
    # the row's own columns are kept in one, so that their names can't clash with those made here
    rows = docs.select(F.struct(*own).alias("row"))
    joined = rows.join(lost, F.col("row")[id_col].eqNullSafe(F.col("doc")), "left")
    hashes, before = F.col("hashes"), F.col("before")
    after = F.when(hashes.isNull(), before).otherwise(F.filter(before, lambda x: ~F.array_contains(hashes, F.xxhash64(line_key(x)))))
    out = joined.select("row", "hashes", _lines(F.col("row")[text_col]).alias("before")).withColumn("after", after)
    return out.select(
        *[(F.array_join("after", "\n") if c == text_col else F.col("row")[c]).alias(c) for c in own],
        F.size("before").cast("long").alias("n_lines"),
        (F.size("before") - F.size("after")).cast("long").alias("n_dropped"),
    )


#: The query in DuckDB SQL.
SQL = r"""
WITH lines AS (
  SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
held AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT lines.*, held.k IS NOT NULL AND doc_id <> last AS lost FROM lines LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
