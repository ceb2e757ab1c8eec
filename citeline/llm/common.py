"""Pieces shared by the training-data operators: table access, durable cuts, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.session import cut, release, scratch, shared_folder, table  # noqa: F401  the operators take them from here


def small_batches(spark: SparkSession, rows: int = 500, size: int = 4 << 20) -> None:
    """Keep Arrow batches of whole texts, or of blocks of them, small, so that a worker's memory does not follow their length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def stored(df: DataFrame) -> DataFrame:
    """Write whole rows as Parquet into the shared folder and read them again; what is not discarded is deleted when the application ends."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for this table; nothing may read it afterwards."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("stored-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, on: str, share: int = 2000) -> DataFrame:
    """Inner join of ``left`` with one row per ``on`` of ``right``, whose column ``__n`` says how many rows of left have it.

    Keys with more than one ``share``-th of all rows, of which there are fewer than ``share``, are
    broadcast; the others meet in a shuffle in which no key is hot.
    """
    right = cut(right)
    total = right.agg(F.sum("__n")).first()[0] or 0
    hot = right.where(F.col("__n") * share > total).drop("__n").withColumn("__hot", F.lit(True))
    cold = right.where(F.col("__n") * share <= total).drop("__n")
    first = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on)
    return first.drop("__hot").unionByName(rest)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named c0, c1, ... by place, so that columns added to it clash with none."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def narrowed(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """As many partitions as so many rows fill; a small table keeps few tasks and files, a large one all of them."""
    return df.coalesce(rows // each + 1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, component) per node in an edge.

    Alternating large-star and small-star rounds: each round points every node at the smallest id
    among its neighbours, so paths shorten geometrically and the number of rows never grows.
    Every step is an aggregation or an equi-join; no component is gathered anywhere. Null ends and
    self-loops are ignored; no edge gives no row. ``max_rounds`` only guards against a defect: not
    converging by then raises instead of returning a partial answer.
    """
    links = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    rows = links.count()
    for _ in range(max_rounds):
        links = narrowed(links, rows)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = narrowed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
        large = narrowed(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows)
        low = narrowed(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        pair = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(pair).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        links = cut(narrowed(small, rows))
        # A forest of stars: nobody has two parents, and nobody points at a node that itself points further.
        bad = links.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        deep = links.select(F.col("v").alias("u")).distinct().join(bad.select("u"), "u", "left_semi")
        if not narrowed(bad.where("n > 1").select("u").unionByName(deep), rows).limit(1).collect():
            roots = narrowed(links.select(F.col("v").alias("node"), F.col("v").alias("component")), rows).distinct()  # few tasks add up a hub's rows
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
