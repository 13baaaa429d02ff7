"""A vector index on storage: inverted lists by k-means cell, in folders that a search prunes and a drain replaces one by one.

Below the root lie

    centers/gen=<g>, models/gen=<g>      the cells' centres of a generation, as rows and as a model
    lists/gen=<g>/written=<v>/cell=<c>   the rows of a cell, as version v wrote them
    versions/<v>/cells                   where each cell's rows lie, and how many
    versions/<v>/about                   generation, cells asked for, rows

A version appears by one rename, so a search sees the one before or the one
after, and a job that dies leaves the last one as it was. A drain writes the
cells anew that rows come to or leave, and no others; the rest is the same files
under a new version. Centres stay until the number of cells that the rows ask
for is more than BAND times away from the number there is; then a generation of
its own is fitted and written.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Folder, Versions, shared_dir
from .vectors import MAX_FIT, dot, nlists, normalized, with_genres

#: Cells may be this many times too few or too many before all is fitted anew.
BAND = 2.0
#: Rounds of k-means at most. A search is exact over the cells that it probes, however well they are fitted.
ROUNDS = 10
ROW = "file_id long, vector array<double>, vector_n array<double>, genres array<string>, created_at long"


class VectorIndex:
    """Cosine search over file_id, vector, genres and created_at; a file has one row. Vectors of length zero lie in some cell and score 0."""

    def __init__(self, spark: SparkSession, root: str | None = None, group: int = 15):
        """`group` vectors make a cell, within 10 and 4,000 cells; without `root` a new folder that executors share is taken."""
        self.spark, self.group = spark, group
        self.root = (root or shared_dir(spark)).rstrip("/")
        self.versions, self.folder = Versions(spark, self.root), Folder(spark, self.root)

    # what there is

    def about(self, version: int | None = None):
        """gen, lists, docs and the version, or None before the first."""
        version = self.versions.latest() if version is None else version
        return self.versions.read("about", version).withColumn("version", F.lit(version)).first() if version else None

    def centers(self, gen: int) -> DataFrame:
        return self.spark.read.schema("cell int, center array<double>").parquet(f"{self.root}/centers/gen={gen}")

    def _rows(self, gen: int, places: DataFrame) -> DataFrame:
        """The rows of the cells in `places` (cell, written). There are 4,000 cells at most, so that which to open is a filter of constants on the folders' names."""
        by: dict[int, list[int]] = {}
        for r in places.select("written", "cell").collect():
            by.setdefault(r.written, []).append(r.cell)
        rows = self.spark.read.schema(f"{ROW}, written int, cell int").option("basePath", f"{self.root}/lists/gen={gen}").parquet(f"{self.root}/lists/gen={gen}")
        wanted = F.lit(False)
        for written, cells in sorted(by.items()):
            wanted |= (F.col("written") == written) & F.col("cell").isin(sorted(cells))
        return rows.where(wanted)

    def rows(self, version: int | None = None) -> DataFrame:
        about = self.about(version)
        if about is None:
            return self.spark.createDataFrame([], f"{ROW}, written int, cell int")
        return self._rows(about.gen, self.versions.read("cells", about.version))

    # writing

    def _fit(self, unit: DataFrame, lists: int, gen: int) -> None:
        """Centres from a bounded sample: the MAX_FIT rows of smallest hashes of file_id. Every row is put into a cell afterwards.

        The sample comes out of its limit as one partition and is dealt out
        again, or one task would do all the fitting. Centres begin as random
        rows: the choice by k-means|| ends in a k-means of several times
        `lists` rows on the driver alone, whose work is the square of `lists`.
        """
        sample = unit.select("file_id", "vector_n").orderBy(F.xxhash64("file_id"), "file_id").limit(MAX_FIT)
        tasks = self.spark.sparkContext.defaultParallelism
        dealt = sample.repartition(tasks, "file_id").sortWithinPartitions("file_id").select(array_to_vector("vector_n").alias("features"))
        model = KMeans(k=lists, seed=7, initMode="random", maxIter=ROUNDS, featuresCol="features").fit(dealt)
        model.write().overwrite().save(f"{self.root}/models/gen={gen}")
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        self.spark.createDataFrame(rows, "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centers/gen={gen}")

    def _assigned(self, unit: DataFrame, gen: int) -> DataFrame:
        """With the cell of the nearest centre. The model holds 4,000 centres at most and goes to every task."""
        if self.centers(gen).isEmpty():
            return unit.withColumn("cell", F.lit(None).cast("int"))
        model = KMeansModel.load(f"{self.root}/models/gen={gen}").setFeaturesCol("features").setPredictionCol("cell")
        return model.transform(unit.withColumn("features", array_to_vector("vector_n"))).drop("features")

    def _write(self, rows: DataFrame, gen: int, version: int) -> DataFrame:
        """Writes the cells of `rows` for this version and returns their places. Rebalancing splits a cell that is large over several files."""
        at = f"{self.root}/lists/gen={gen}/written={version}"
        columns = [c.split()[0] for c in ROW.split(", ")]
        rows.select(*columns, "cell").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(at)
        written = self.spark.read.schema(f"{ROW}, cell int").parquet(at)
        return written.groupBy("cell").agg(F.count("*").alias("docs")).withColumn("written", F.lit(version))

    def _publish(self, version: int, gen: int, lists: int, cells: DataFrame) -> int:
        about = cells.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).select(F.lit(gen).alias("gen"), F.lit(lists).alias("lists"), "docs")
        self.versions.publish(version, cells=cells.select("cell", "written", "docs").coalesce(1), about=about)
        return version

    def build(self, vectors: DataFrame, tags: DataFrame | None = None, lists: int | None = None) -> int:
        """A new generation of these vectors (file_id, vector, and created_at or not), with genres from `tags`; returns the version."""
        return self._build(self._prepared(vectors, tags), lists)

    def _build(self, unit: DataFrame, lists: int | None = None) -> int:
        about, version = self.about(), self.versions.latest() + 1
        gen = about.gen + 1 if about else 1
        lists = lists or self.wanted(unit.count())
        if unit.isEmpty():
            self.spark.createDataFrame([], "cell int, center array<double>").write.mode("overwrite").parquet(f"{self.root}/centers/gen={gen}")
        else:
            self._fit(unit, lists, gen)
        return self._publish(version, gen, lists, self._write(self._assigned(unit, gen), gen, version))

    def wanted(self, docs: int) -> int:
        """Cells for so many rows."""
        return self.spark.range(1).select(nlists(F.lit(docs), self.group)).first()[0]

    def _prepared(self, vectors: DataFrame, tags: DataFrame | None) -> DataFrame:
        """One row a file, its latest, with its unit vector and genres; a row without vector is left out."""
        created = F.col("created_at").cast("long") if "created_at" in vectors.columns else F.lit(0).cast("long")
        rows = vectors.where("file_id IS NOT NULL AND vector IS NOT NULL").select("file_id", F.col("vector").cast("array<double>").alias("vector"), created.alias("created_at"))
        latest = rows.groupBy("file_id").agg(F.max(F.struct("created_at", "vector")).alias("v")).select("file_id", "v.vector", "v.created_at")
        named = with_genres(latest, tags) if tags is not None else latest.withColumn("genres", F.array().cast("array<string>"))
        return normalized(named)

    def drain(self, hot: DataFrame, tags: DataFrame | None = None) -> int:
        """Moves hot vectors in: a file's hot vector replaces its cold one. Returns the version, the last one if `hot` is empty.

        The hot rows are written once (to the folder of drafts), as they are
        read for the cells that they come to, those that they leave, and the rows.
        """
        about = self.about()
        if about is None or about.docs == 0:
            unit = self._prepared(hot, tags)
            return self.versions.latest() if about and unit.isEmpty() else self._build(unit)
        version, draft = about.version + 1, f"drafts/hot-{self.versions.latest() + 1}"
        self._assigned(self._prepared(hot, tags), about.gen).write.mode("overwrite").parquet(f"{self.root}/{draft}")
        new = self.spark.read.parquet(f"{self.root}/{draft}")
        if new.isEmpty():
            self.folder.delete(draft)
            return about.version
        places = self.versions.read("cells", about.version)
        old = self._rows(about.gen, places)
        left = old.select("file_id", "cell").join(new.select("file_id"), "file_id", "left_semi").select("cell")
        touched = [r.cell for r in left.union(new.select("cell")).distinct().collect()]  # 4,000 at most
        stay = self._rows(about.gen, places.where(F.col("cell").isin(touched))).join(new.select("file_id"), "file_id", "left_anti")
        cells = self._write(stay.select(*new.columns).union(new), about.gen, version)
        cells = cells.unionByName(places.where(~F.col("cell").isin(touched)).select("cell", "docs", "written"))
        self._publish(version, about.gen, about.lists, cells)
        self.folder.delete(draft)
        return version

    def promote(self, hot: DataFrame, tags: DataFrame | None = None) -> int:
        """Drains, and fits a new generation if the number of cells has become wrong. With nothing to drain and a right number nothing happens."""
        version = self.drain(hot, tags)
        return self._build(self.rows(version).drop("cell", "written")) if self.outgrown() else version

    def outgrown(self) -> bool:
        about = self.about()
        wanted = self.wanted(about.docs)
        return not about.lists / BAND <= wanted <= about.lists * BAND

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions but the last `keep`, and the cells and centres that only those had. Searches of older versions must have ended."""
        numbers = sorted(int(n) for n in self.folder.names("versions"))
        kept, gone = numbers[-keep:], numbers[:-keep]
        used = {(self.about(v).gen, r.written) for v in kept for r in self.versions.read("cells", v).select("written").distinct().collect()}
        for g in self.folder.names("lists"):
            gen = int(g.removeprefix("gen="))
            for w in self.folder.names(f"lists/{g}"):
                if w.startswith("written=") and (gen, int(w.removeprefix("written="))) not in used:
                    self.folder.delete(f"lists/{g}/{w}")
            if gen not in {x for x, _ in used}:
                self.folder.delete(f"lists/{g}")
                self.folder.delete(f"centers/{g}")
                self.folder.delete(f"models/{g}")
        for v in gone:
            self.folder.delete(f"versions/{v}")

    # searching

    def probed(self, query: list[float], probes: int, version: int | None = None) -> DataFrame:
        """The rows of the `probes` cells whose centres are nearest to the query; other cells' folders are not opened."""
        about = self.about(version)
        if about is None:
            return self.rows()
        q = F.lit([float(x) for x in query])
        places = self.versions.read("cells", about.version)
        near = self.centers(about.gen).withColumn("s", _cosine(F.col("center"), q)).join(F.broadcast(places), "cell")
        return self._rows(about.gen, near.orderBy(F.desc("s"), "cell").limit(probes))

    def search(self, query: list[float], k: int, probes: int, genre: str | None = None, without: int | None = None, min_score: float | None = None, version: int | None = None) -> DataFrame:
        """file_id and score of the k nearest by cosine; of a genre if one is given, without one file, of `min_score` at least."""
        rows = self.probed(query, probes, version)
        if genre is not None:
            rows = rows.where(F.array_contains("genres", genre))
        if without is not None:
            rows = rows.where(F.col("file_id") != without)
        scored = rows.select("file_id", F.round(_cosine(F.col("vector"), F.lit([float(x) for x in query])), 6).alias("score"))
        best = scored.orderBy(F.desc("score"), "file_id").limit(k)
        return best.where(F.col("score") >= min_score) if min_score is not None else best

    def vector_of(self, file_id: int) -> list[float] | None:
        r = self.rows().where(F.col("file_id") == file_id).select("vector").first()
        return list(r.vector) if r else None


def _cosine(a: Column, b: Column) -> Column:
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
