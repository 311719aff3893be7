"""What several operators share: tables, scratch tables in the shared folder, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, *names: str) -> str | list[str]:
    """Column names that the frame hasn't, one for each of names: callers may hold any column."""
    taken = {c.lower() for c in frame.columns}
    mark = "__"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return mark + names[0] if len(names) == 1 else [mark + n for n in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new temporary one if all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables as Parquet in the shared folder, which any executor can read again.

    They cut lineage like checkpoint() but are written once, in columns. Hadoop deletes them when the
    driver's JVM ends, since a lazily returned result may still read them; drop() deletes one early, and
    `dropped_after` all that are made while it lasts.
    """

    made: list[Scratch] | None = None

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tables = spark, {}
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._fs.deleteOnExit(self._path(self.root))
        if Scratch.made is not None:
            Scratch.made.append(self)

    def folder(self, name: str) -> str:
        """The path of a new folder for files that aren't tables."""
        self._fs.mkdirs(self._path(f"{self.root}/{name}"))
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def save_buckets(self, frame: DataFrame, name: str, keys: list[str], order: list[str], buckets: int) -> DataFrame:
        """Saved in buckets by keys, each one file in that order, so joins on keys leave the rows where they are.

        Buckets are known to the catalog, so it has a table of them until drop().
        """
        path, called = f"{self.root}/{name}", f"tabulon_{uuid.uuid4().hex}"
        self.tables[name] = called
        dealt = frame.repartition(buckets, *keys)
        dealt.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*order).saveAsTable(called)
        return self.spark.table(called)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def drop_all(self) -> None:
        self.drop(*list(self.tables))
        self._fs.delete(self._path(self.root), True)


@contextmanager
def dropped_after() -> Iterator[None]:
    """Deletes the scratch tables of all that is made inside, when its results have been written elsewhere."""
    before, Scratch.made = Scratch.made, []
    try:
        yield
    finally:
        for scratch in Scratch.made:
            scratch.drop_all()
        Scratch.made = before


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id reachable.

    Each round gives every id its smallest smaller neighbour as parent, follows parents to their roots by
    pointer jumping, and relabels the edges, so only roots are left. Aggregations are by min, which
    combines before the shuffle; nothing is collected but emptiness flags.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rest = scratch.save(edges.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), f"{name}-e0")
    labels = scratch.save(rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct().select("id", F.col("id").alias("component")), f"{name}-l0")
    n = 0
    while not rest.isEmpty():
        n += 1
        jump = scratch.save(rest.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), f"{name}-p{n}-0")
        k, moved = 0, True
        while moved:
            k += 1
            up = jump.select(F.col("v").alias("p"), F.col("p").alias("q"))
            new = jump.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("m"))
            new = scratch.save(new, f"{name}-p{n}-{k}")
            moved = not new.filter("m").isEmpty()
            scratch.drop(f"{name}-p{n}-{k - 1}")
            jump = new.select("v", "p")
        new = labels.join(jump, labels["component"] == jump["v"], "left").select("id", F.coalesce("p", "component").alias("component"))
        labels = scratch.save(new, f"{name}-l{n}")
        a, b = jump.select(F.col("v").alias("a"), F.col("p").alias("pa")), jump.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        new = rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        rest = scratch.save(new.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), f"{name}-e{n}")
        scratch.drop(f"{name}-e{n - 1}", f"{name}-l{n - 1}", f"{name}-p{n}-{k}")
    return labels


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number in each one's component, by spreading minima over links a-b and jumping."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while ((jumped := new[new]) != new).any():
            new = jumped
        if (new == label).all():
            return label
        label = new
