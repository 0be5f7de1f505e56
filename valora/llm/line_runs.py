"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps, in a folder, how many documents hold each line key.  A
*run* is a table of ``h1, h2, n`` (two 64-bit hashes of a key, and its number of
documents), bucketed and sorted by the hashes; keys known to be in ``least``
documents or more are its *settled* part.  A new batch of documents is counted,
merge-anti-joined with the settled parts of all runs (their keys need no more
counting) and added as a run of level 0.  Whenever a level has ``fanout`` runs,
they are merged into one run of the next level, so a key is rewritten a number
of times that grows with the logarithm of the batches.  Buckets make merges and
anti-joins read the runs in place: only a batch's own counts are shuffled, after
their partial sums.

``strip`` drops the lines of frequent keys from documents.  Only hashes and line
numbers meet the keys.  Keys that make up more than ``1 / HEAVY`` of a batch's
counts are noted as hot, fewer than ``HEAVY`` a batch; every key with more than
that share of all batches is among them.  Those that are frequent are broadcast,
and their rows dealt by place instead of by key, so a line that a third of all
documents hold is no hot group; all other keys are merge-joined.

Everything is DataFrame work: no Python runs in a task.  A run folder is written
whole before the list of runs names it, and every list is a new file, so a lost
driver or executor leaves the last list valid; ``LineRuns.open`` goes on there.

Defined cases: a null or empty text is one empty line; keys with fewer than
``shortest`` code points are never counted; a key that a document holds several
times counts once; every row counts as a document, rows with equal or null ids
too; lines are never cut; an empty table gives an empty result; further columns
of any name are ignored.  Two keys are taken for one only if 128 bits of their
hashes agree.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.session import cut_lineage, ensure_checkpoint_dir

LEAST = 10
SHORTEST = 1
BATCHES = 8
FANOUT = 4
HEAVY = 1024
SALTS = 64

# White space of a key's ends, and the letters that are lowered.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def document_counts(docs: DataFrame, text_col: str, shortest: int) -> DataFrame:
    """``h1, h2, n``: in how many rows each key is found."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines_of(F.col(f"`{text_col}`")), key_of))).alias("key"))
    return (keys.where(F.length("key") >= shortest).select(*_hashes("key"))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))


class LineRuns:
    """Document counts of line keys in the runs of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST, shortest: int = SHORTEST,
                 fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.least, self.shortest, self.fanout = spark, folder, least, shortest, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[dict] = []   # level and table of each run, oldest first
        self.version = 0

    # ---- the list of runs

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The state after the last batch that was added whole."""
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("list-"))
        done = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        state = json.loads(spark.read.text(f"{folder}/{done[-1]}").first()["value"])
        out = cls(spark, folder, state["least"], state["shortest"], state["fanout"], state["buckets"])
        out.version = state["version"]
        for r in state["runs"]:
            out._attach(r["table"])
            out.runs.append(r)
        return out

    def _save(self) -> None:
        self.version += 1
        state = {"least": self.least, "shortest": self.shortest, "fanout": self.fanout, "buckets": self.buckets,
                 "version": self.version, "runs": self.runs}
        one = self.spark.range(1, numPartitions=1).select(F.lit(json.dumps(state)).alias("value"))
        one.write.mode("overwrite").text(f"{self.folder}/list-{self.version:08d}")

    def _attach(self, table: str) -> None:
        """Name a run that an earlier application has written."""
        place = f"{self.folder}/{table}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (h1 BIGINT, h2 BIGINT, n BIGINT, settled BOOLEAN) USING parquet "
                       f"PARTITIONED BY (settled) CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS "
                       f"LOCATION '{place}'")
        self.spark.sql(f"MSCK REPAIR TABLE {table}")

    def close(self) -> None:
        """Forget the names of the runs; their files stay."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r['table']}")

    # ---- runs

    def _write(self, counts: DataFrame, level: int, replaced: list[dict]) -> None:
        table = f"line_run_{uuid.uuid4().hex}"
        rows = (counts.withColumn("settled", F.col("n") >= self.least)
                .repartition(self.buckets, "h1", "h2").sortWithinPartitions("settled", "h1", "h2"))
        (rows.write.partitionBy("settled").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{table}").format("parquet").saveAsTable(table))
        self.runs = [r for r in self.runs if r not in replaced] + [{"level": level, "table": table}]
        self._save()
        for r in replaced:
            self.spark.sql(f"DROP TABLE IF EXISTS {r['table']}")

    def _merged(self, runs: list[dict]) -> DataFrame:
        tables = [self.spark.table(r["table"]).select("h1", "h2", "n") for r in runs]
        every = tables[0]
        for t in tables[1:]:
            every = every.unionAll(t)
        return every.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count a batch of documents that no earlier batch held."""
        fresh = cut_lineage(document_counts(docs, text_col, self.shortest))
        total = fresh.agg(F.sum("n")).first()[0] or 0
        fresh.where(F.col("n") * HEAVY > total).select("h1", "h2").coalesce(1).write.mode("append").parquet(f"{self.folder}/hot")
        for r in self.runs:
            settled = self.spark.table(r["table"]).where("settled").select("h1", "h2")
            fresh = fresh.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(fresh, 0, [])
        level = 0
        while len(full := [r for r in self.runs if r["level"] == level]) >= self.fanout:
            self._write(self._merged(full), level + 1, full)
            level += 1

    def frequent(self) -> DataFrame:
        """``h1, h2, n`` of the keys in at least ``least`` documents; ``n`` does
        not go on counting where a key was known to be one of them."""
        if len(self.runs) > 1:
            self._write(self._merged(self.runs), max(r["level"] for r in self.runs) + 1, list(self.runs))
        return self.spark.table(self.runs[0]["table"]).where("settled").select("h1", "h2", "n")

    # ---- documents without the frequent lines

    def strip(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id, n_lines, n_dropped, kept_text`` of every row of ``docs``."""
        frequent = self.frequent()
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        own = F.col(f"`{id_col}`")
        named = docs.select(own.alias("id"), F.xxhash64(own, text).alias("d1"),
                            F.xxhash64(F.lit("second"), own, text).alias("d2"), own.isNull().alias("anonymous"),
                            lines_of(text).alias("lines"))
        places = (named.select("d1", "d2", "anonymous", F.posexplode(F.transform("lines", key_of)).alias("at", "key"))
                  .where(F.length("key") >= self.shortest).select("d1", "d2", "anonymous", "at", *_hashes("key")))
        hot = F.broadcast(self.spark.read.parquet(f"{self.folder}/hot").distinct())
        heavy = frequent.join(hot, ["h1", "h2"], "left_semi").select("h1", "h2", F.lit(True).alias("heavy"))
        rest = frequent.join(hot, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(True).alias("listed"))
        marked = places.join(F.broadcast(heavy), ["h1", "h2"], "left")
        dealt = marked.select("d1", "d2", "anonymous", "at", "heavy",
                              F.when(F.col("heavy"), F.xxhash64("d1", "at")).otherwise(F.col("h1")).alias("h1"),
                              F.when(F.col("heavy"), F.col("d2")).otherwise(F.col("h2")).alias("h2"))
        found = dealt.join(rest.hint("merge"), ["h1", "h2"], "left").where("heavy OR listed")
        # rows with null ids and equal texts are one key: spread over salts, each of which gets its lines
        salts = F.when(F.col("anonymous"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        dropped = (found.groupBy("d1", "d2", "anonymous").agg(F.collect_set("at").alias("dropped"))
                   .select("d1", "d2", F.explode(salts).alias("salt"), "dropped"))
        salt = F.when(F.col("anonymous"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
        joined = named.withColumn("salt", salt.cast("int")).join(dropped, ["d1", "d2", "salt"], "left")
        # `lines` comes out of a join, so it is split once a row, not once a line
        every = F.sequence(F.lit(0), F.size("lines") - 1)
        kept = F.transform(F.array_except(every, "dropped"), lambda i: F.get("lines", i))
        return joined.select(
            F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
            F.array_join(F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(kept), "\n").alias("kept_text"))


def file_batches(docs: DataFrame, most: int = BATCHES) -> list[DataFrame]:
    """A parquet table as at most ``most`` batches of its files, each read once."""
    files, spark = sorted(docs.inputFiles()), docs.sparkSession
    size = -(-len(files) // most) or 1
    return [spark.read.schema(docs.schema).parquet(*files[i:i + size]) for i in range(0, len(files), size)] or [docs]


def deduplicate(batches: list[DataFrame], least: int = LEAST, shortest: int = SHORTEST, fanout: int = FANOUT,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents of the batches without the lines that ``least`` of them
    or more hold: ``id, n_lines, n_dropped, kept_text``.  The name of the last
    run stays in the catalog, as the result is read from it."""
    spark = batches[0].sparkSession
    runs = LineRuns(spark, f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}", least, shortest, fanout)
    for b in batches:
        runs.add(b, text_col)
    docs = batches[0]
    for b in batches[1:]:
        docs = docs.unionByName(b)
    return runs.strip(docs, id_col, text_col)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
o AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY r)
SELECT d.doc_id, o.n_lines, o.n_dropped, sha256(o.kept) AS kept_sha256 FROM d JOIN o ON d.r = o.r
"""
