"""How often every distinct term occurs, and in how many records, kept up to date by signed deltas.

The counts live in a folder of tables, cut into buckets by a hash of the key. A change set holds only added (+1) and removed
(-1) rows (a changed row is both); it is aggregated to signed occurrence and record changes per term, and only the buckets
that it touches are read, merged and written anew. A manifest names, for every bucket, the version that holds it; it is
written last, so a job that is cut off leaves the last complete version in force, and opening the folder again finds that
version. The number of buckets follows from the number of terms and grows with it.

Where several rows make up one record (``record``), a second table holds how many rows of each record have each term, so that
a record stops counting for a term only when the last of its rows with the term is gone.

Defined results: null texts have no terms but count as records; empty texts likewise; repeated rows count each time; terms
whose counts fall to zero leave the table; an empty change set makes a version without changes; removing what was never
there gives negative counts, which stay until the addition comes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import materialise, scratch_path

TERMS_PER_BUCKET, LEAST_BUCKETS = 500_000, 8
COUNTS = "field_name string, term string, n_occurrences bigint, n_records bigint"
ROWS = "field_name string, record string, term string, n bigint"
MANIFEST = "name string, bucket int, buckets int, version bigint, n bigint"
TOTALS = "field_name string, n_records bigint"


@dataclass
class Changes:
    """A change set of one field: rows with ``sign``, the array of terms of a row, and the columns that the rows of one
    record share (None: each row is a record)."""

    field: str
    rows: DataFrame
    terms: Column
    record: list[str] | None = None


def changes(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """The signed difference between two states of a table: only rows that differ, with ``sign``."""
    old, new = before.select(*columns), after.select(*columns)
    return new.exceptAll(old).withColumn("sign", F.lit(1)).unionByName(old.exceptAll(new).withColumn("sign", F.lit(-1)))


def term_deltas(c: Changes) -> DataFrame:
    """Signed changes per term where each row is a record. A row's sorted terms tell which occurrence is its first, so one
    explode and one aggregation give both counts; the map-side combine sums before the shuffle, so a term in a third of all
    records is no hot key."""
    ordered = c.rows.select("sign", F.array_sort(c.terms).alias("ts"))
    first = lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (F.get(F.col("ts"), i - 1) != x), 1).otherwise(0).alias("first"))
    each = ordered.select("sign", F.explode(F.transform("ts", first)).alias("e"))
    sums = each.groupBy(F.col("e.term").alias("term")).agg(F.sum("sign").alias("n_occurrences"), F.sum(F.col("sign") * F.col("e.first")).alias("n_records"))
    return sums.where("n_occurrences <> 0 OR n_records <> 0").select(F.lit(c.field).alias("field_name"), "term", "n_occurrences", "n_records")


def row_deltas(c: Changes) -> DataFrame:
    """Signed changes of the rows of each record that have each term; the null term stands for the record itself."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in c.record])
    each = c.rows.select("sign", key.alias("record"), F.explode(F.array_append(c.terms, F.lit(None).cast("string"))).alias("term"))
    return each.groupBy("record", "term").agg(F.sum("sign").alias("n")).where("n <> 0").select(F.lit(c.field).alias("field_name"), "record", "term", "n")


class TermCounts:
    """The persistent counts in a folder; opening it finds its last complete version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = max(self._versions(), default=0)

    def _folder(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at, jvm

    def _versions(self) -> list[int]:
        fs, at, jvm = self._folder()
        if not fs.exists(at):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(at)]
        return [int(n.partition("-")[2]) for n, p in names if n.startswith("manifest-") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def _manifest(self, name: str) -> list[tuple[int, int, int, int]]:
        """bucket, number of buckets, version and rows of each bucket of a table; a few thousand at most."""
        if not self.version:
            return []
        got = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest-{self.version}").where(F.col("name") == name)
        return [(r.bucket, r.buckets, r.version, r.n) for r in got.toLocalIterator()]

    def _read(self, name: str, schema: str, held: list[tuple[int, int, int, int]]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}-{v}/bucket={b}" for b, _, v, _ in held])

    def counts(self) -> DataFrame:
        return self._read("counts", COUNTS, self._manifest("counts"))

    def totals(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/totals-{self.version}")

    def _merge(self, name: str, schema: str, by: str, keys: list[str], sums: list[str], deltas: DataFrame, n: int) -> tuple[list[tuple], DataFrame]:
        """Adds deltas to a table: the new manifest rows, and old and new sums of the keys in the touched buckets."""
        held = self._manifest(name)
        size, buckets = sum(h[3] for h in held), held[0][1] if held else 0
        more = deltas.count()
        if not buckets or size + more > 2 * buckets * TERMS_PER_BUCKET:
            buckets, touched = max(LEAST_BUCKETS, 2 * buckets, -(-(size + more) // TERMS_PER_BUCKET)), held  # all move to new buckets
            kept = []
        else:
            place = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
            at = {r[0] for r in deltas.select(place).distinct().toLocalIterator()}
            touched, kept = [h for h in held if h[0] in at], [h for h in held if h[0] not in at]
        old = self._read(name, schema, touched).select(*keys, *[F.col(s).alias(f"old_{s}") for s in sums], *[F.lit(0).cast("bigint").alias(f"d_{s}") for s in sums])
        new = deltas.select(*keys, *[F.lit(0).cast("bigint").alias(f"old_{s}") for s in sums], *[F.col(s).alias(f"d_{s}") for s in sums])
        merged = old.unionByName(new).groupBy(*keys).agg(*[F.sum(f"old_{s}").alias(f"old_{s}") for s in sums], *[(F.sum(f"old_{s}") + F.sum(f"d_{s}")).alias(s) for s in sums])
        merged = materialise(merged.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")), f"merged-{name}")
        alive = merged.where(" OR ".join(f"{s} <> 0" for s in sums))
        alive.select(*[c.strip().split()[0] for c in schema.split(",")], "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}-{n}")
        rows = [(name, r.bucket, buckets, n, r["n_rows"]) for r in alive.groupBy("bucket").agg(F.count("*").alias("n_rows")).toLocalIterator()]
        return [(name, b, buckets, v, c) for b, _, v, c in kept] + rows, merged

    def merge(self, *sets: Changes) -> TermCounts:
        """Adds change sets to the counts and makes that the current version."""
        n = max(self._versions(), default=0) + 1
        deltas, totals, manifest = [term_deltas(c) for c in sets if not c.record], [], []
        for c in sets:
            if not c.record:
                totals.append(c.rows.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("n_records")).select(F.lit(c.field).alias("field_name"), "n_records"))
        shared = [row_deltas(c) for c in sets if c.record]
        if shared:
            rows = shared[0]
            for r in shared[1:]:
                rows = rows.unionByName(r)
            of_rows, merged = self._merge("rows", ROWS, "record", ["field_name", "record", "term"], ["n"], materialise(rows, "row-deltas"), n)
            manifest += of_rows
            is_in = (F.col("n") > 0).cast("bigint") - (F.col("old_n") > 0).cast("bigint")
            changed = merged.where("n <> old_n")
            words = changed.where("term IS NOT NULL").groupBy("field_name", "term").agg(F.sum(F.col("n") - F.col("old_n")).alias("n_occurrences"), F.sum(is_in).alias("n_records"))
            deltas.append(words.where("n_occurrences <> 0 OR n_records <> 0"))
            totals.append(changed.where("term IS NULL").groupBy("field_name").agg(F.sum(is_in).alias("n_records")))
        else:
            manifest += [("rows", *h) for h in self._manifest("rows")]
        both = deltas[0]
        for d in deltas[1:]:
            both = both.unionByName(d)
        of_counts, _ = self._merge("counts", COUNTS, "term", ["field_name", "term"], ["n_occurrences", "n_records"], materialise(both, "term-deltas"), n)
        manifest += of_counts
        all_totals = self.totals()
        for t in totals:
            all_totals = all_totals.unionByName(t)
        all_totals.groupBy("field_name").agg(F.sum("n_records").alias("n_records")).write.mode("overwrite").parquet(f"{self.path}/totals-{n}")
        self.spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{n}")
        self.version = n
        return self

    def expire(self) -> int:
        """Removes the buckets, totals and manifests that the current version does not use; how many folders went."""
        fs, at, jvm = self._folder()
        used = {f"{name}-{v}/bucket={b}" for name in ("counts", "rows") for b, _, v, _ in self._manifest(name)}
        gone = 0
        for s in fs.listStatus(at):
            name, _, v = s.getPath().getName().partition("-")
            if name in ("totals", "manifest") and int(v) < self.version:
                gone += fs.delete(s.getPath(), True)
            elif name in ("counts", "rows"):
                for p in fs.listStatus(s.getPath()):
                    if p.getPath().getName().startswith("bucket=") and f"{name}-{v}/{p.getPath().getName()}" not in used:
                        gone += fs.delete(p.getPath(), True)
        return gone

    def marks(self, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
        """Terms in fewer than ``rare_below`` records, and those in more than ``common_above`` of all records."""
        # One total per field: a table of as many rows as there are fields.
        t = self.counts().join(F.broadcast(self.totals().withColumnRenamed("n_records", "of_records")), "field_name")
        rare = F.when(F.col("n_records") < rare_below, F.lit("rare"))
        common = F.when(F.col("n_records") > common_above * F.col("of_records"), F.lit("common"))
        return t.select("*", F.explode(F.array_compact(F.array(rare, common))).alias("mark"))


def new_counts(spark: SparkSession) -> TermCounts:
    return TermCounts(spark, scratch_path(spark, "term-counts"))
