"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower

#: What is stripped at both ends of a line: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"


def short_digest(text: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def line_digests(text: Column, least_chars: int) -> Column:
    """For each line the digest of its key, null where the key is shorter than ``least_chars`` code points."""
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= least_chars, short_digest(key)))


class LineRuns:
    """An index of lines as runs (_hash, docs, top), each a table bucketed and sorted by hash, with one row a hash. top is the largest document id.

    ``absorb`` adds a batch: its hashes are merge-anti-joined with every run, which takes out those that add nothing to what one run knows
    already (the line is in ``least`` documents and in a larger id), and the rest becomes a run of level 0. ``fan`` runs of one level are merged into
    one of the next, so that n batches leave about fan * log(n) runs and a row is rewritten log(n) times. The buckets are as many as the shuffle partitions,
    so that joins and merges read the runs without shuffling them. Batches may come in any order.
    """

    def __init__(self, work: Workspace, least: int = 5, fan: int = 3):
        self.work, self.least, self.fan, self.levels, self.made = work, least, fan, {}, 0
        self.buckets = int(work.spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [self.work.spark.table(name) for level in sorted(self.levels) for name, _ in self.levels[level]]

    def absorb(self, lines: DataFrame) -> None:
        """lines: (_hash, _id), one row for each document of the batch and each of its different lines."""
        own = lines.groupBy("_hash").agg(F.count(F.lit(1)).alias("docs"), F.max("_id").alias("top"))
        for run in self.runs():
            known = run.where(F.col("docs") >= self.least).select(F.col("_hash").alias("_known"), F.col("top").alias("_above"))
            own = own.join(known, (F.col("_hash") == F.col("_known")) & (F.col("top") <= F.col("_above")), "left_anti")
        self._add(own, 0)
        level = 0
        while len(self.levels[level]) >= self.fan:
            old = self.levels.pop(level)
            self._add(merged([self.work.spark.table(name) for name, _ in old]), level + 1)
            for name, folder in old:
                self.work.spark.sql(f"DROP TABLE {name}")
                self.work.drop(folder)
            level += 1

    def _add(self, rows: DataFrame, level: int) -> None:
        folder = f"run{self.made}"
        name, self.made = f"lines_{self.work.root.rsplit('-', 1)[-1]}_{self.made}", self.made + 1
        rows.write.bucketBy(self.buckets, "_hash").sortBy("_hash").option("path", f"{self.work.root}/{folder}").option("compression", "zstd").saveAsTable(name)
        self.levels.setdefault(level, []).append((name, folder))
        self.work.release()

    def repeated(self) -> DataFrame:
        """(_hash, docs, top) of the lines in at least ``least`` documents."""
        return self.work.save(merged(self.runs()).where(F.col("docs") >= self.least), "repeated")

    def drop(self) -> None:
        for name, folder in (x for level in self.levels.values() for x in level):
            self.work.spark.sql(f"DROP TABLE {name}")
            self.work.drop(folder)
        self.levels = {}


def merged(runs: list[DataFrame]) -> DataFrame:
    """One row a hash, by outer merge joins of the sorted runs."""
    out = runs[0]
    for run in runs[1:]:
        other = run.select(F.col("_hash").alias("_other"), F.col("docs").alias("_docs"), F.col("top").alias("_top"))
        both = out.join(other, F.col("_hash") == F.col("_other"), "full")
        out = both.select(F.coalesce("_hash", "_other").alias("_hash"), (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"), F.greatest("top", "_top").alias("top"))
    return out


def drop_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5, batches: int = 6, fan: int = 3) -> DataFrame:
    """One row per document: its id, n_lines, n_dropped and the text that is left (column ``kept``).

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``least_chars`` code points in at least ``least_docs`` documents
    lose all their lines except in the document of the largest id that holds them. Documents are dealt into ``batches`` by hash; each passes once through the
    runs (see LineRuns). Their digests, 16 bytes a long line, are written once, one folder a batch; texts are read twice, and travel once, when the places of the lines to drop
    join them. What is known of hashes is never broadcast by this code.

    Lines of 128 equal bits of SHA-256 count as equal. A document is a row: rows that repeat an id count one each, and all rows of the largest id keep the line. Rows of null
    id count, and lose a line as soon as a row with an id holds it too; a line of null ids alone stays. Null and empty texts are one empty line. A line repeated within a document counts
    once; all its lines go or stay together. Very long texts are used whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    work = Workspace(spark, "lines")
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text")).withColumn("_key", short_digest(F.col("_text")))
    staged = rows.select("_id", "_key", line_digests(F.col("_text"), least_chars).alias("_digests"), F.pmod(F.xxhash64("_id", "_key"), F.lit(batches)).cast("int").alias("_batch"))
    staged = work.save(staged.where(F.exists("_digests", lambda d: d.isNotNull())), "staged", by="_batch")
    index = LineRuns(work, least_docs, fan)
    for batch in range(batches):
        lines = staged.where(F.col("_batch") == batch).select("_id", F.explode(F.array_distinct("_digests")).alias("_hash"))
        index.absorb(lines.where(F.col("_hash").isNotNull()))
    repeated = index.repeated().select("_hash", "top")
    index.drop()
    places = staged.select("_id", "_key", F.posexplode("_digests").alias("_at", "_hash")).where(F.col("_hash").isNotNull())
    lost = places.join(repeated, "_hash").where(F.col("top").isNotNull() & (F.col("_id").isNull() | (F.col("_id") < F.col("top"))))
    lost = lost.groupBy("_id", "_key").agg(F.collect_list("_at").alias("_lost")).select(F.col("_id").alias("_lost_id"), F.col("_key").alias("_lost_key"), "_lost")
    found = rows.join(lost, F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_key") == F.col("_lost_key")), "left")
    lines = F.split("_text", "\n", -1)
    found = found.select("_id", "_text", "_lost", lines.alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    found = found.select("_id", "_text", "_lines", F.when(F.col("_lost").isNotNull(), stay).alias("_stay"))
    kept = F.when(F.col("_stay").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_stay", lambda at: F.get("_lines", at)), "\n"))
    gone = F.when(F.col("_stay").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_stay"))
    return found.select(F.col("_id").alias(id_col), F.size("_lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), kept.alias("kept"))
