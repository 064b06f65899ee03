"""Large JSON envelopes read by many tasks.

``{"status": ..., "data": [{...}, {...}], "count": n}`` may be one document of
any size, on one line or many.  Spark's own JSON reader gives such a document
to one task.  Here it is cut into its records without parsing it as a whole:

1. The file is read as text whose lines end with ``}``, so Spark splits it at
   any byte like a file of short lines.  A block is the part of a file that one
   task reads, in its order.  A document that was landed in parts (``parts``,
   compressed or not) has a part a block instead.
2. Whether a brace counts depends on whether it stands inside a string, which
   depends on everything before it.  So a first pass gives for each block what
   it does to the state if it starts outside a string, inside one, or behind a
   backslash: the state at its end and the change of depth.
3. The blocks' totals, one row a block, are composed in their order; that says
   in which state and at which depth each block starts.
4. A second pass starts each block from there.  An object that opens at the
   depth of the envelope's array elements is a record.  A record that lies in
   one block is whole already; the parts of one over several blocks, at most
   two a block besides whole ones, are brought together by its number.

Both passes read the text where it lies: only the totals are shuffled, and of
the text only the records are written.  The blocks' starts (a kilobyte each at
most) go to every task that reads.

Records come out as JSON lines, which the landed-file reader takes from there,
so keys that no record has stay absent and unknown keys are kept.

A document that ends inside a string, an object or an array fails the job, as
does a record that is no valid JSON.  Elements of the array that are no objects
are no records.  Documents that follow each other in one file are all read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlens.session import scratch_path, twin_session


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(_f, _p, _b, _size, value): the text between closing braces, in the order of the blocks (_f, _b)."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.lit("").alias("_p"), F.col("_metadata.file_block_start").alias("_b"),
        F.col("_metadata.file_size").alias("_size"), "value")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(_f, _p, _b, _size, value): the files, each a part of its folder's document."""
    return spark.read.option("wholetext", True).text(path).select(
        F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_f"), F.col("_metadata.file_name").alias("_p"),
        F.lit(0).cast("long").alias("_b"), F.lit(-1).cast("long").alias("_size"), "value")


def _reading_session(spark: SparkSession) -> SparkSession:
    """A session in which a file is cut into the same blocks each time, though executors come and go."""
    least = "spark.sql.files.minPartitionNum"
    return twin_session(spark, **{least: spark.conf.get(least, None) or str(spark.sparkContext.defaultParallelism)})


def _staged(spark: SparkSession, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def envelope_records(spark: SparkSession, path: str, member: str | None = "data", parts: bool = False) -> DataFrame:
    """(record): the JSON text of each object in the array ``member`` of the documents at ``path``
    (``None``: of an array that is the document itself), on one line.

    ``parts``: the files of a folder are the parts of one document (or of several, one behind the other), cut
    at any byte, shorter names first and names of one length in their order.  A part may be compressed (by its
    name's ending); a task holds it whole, so it should be some tens of megabytes, 2 GB at most.  Otherwise a
    document is a file, not compressed, of which a task reads ``spark.sql.files.maxPartitionBytes`` at most, and
    holds one record.  The blocks of a document are composed in one place, one row a block."""
    from chainlens.sources import envelope_scan as E
    s = _reading_session(spark)
    pieces = _parts(s, path) if parts else _pieces(s, path).withColumn("value", F.concat("value", F.lit("}")))
    blocks = pieces.select("_f", "_p", "_b", "_size", F.col("value").cast("binary").alias("_text"))
    totals = blocks.mapInArrow(E.block_totals, E.TOTALS)
    starts = _staged(s, totals.groupBy("_f").applyInArrow(E.composer(member), E.STARTS), "envelope_blocks")
    broken = starts.where(~F.col("_sound")).select("_f").first()
    if broken:
        raise ValueError(f"{broken['_f']} ends inside a string, an object or an array")
    # Broadcast, so that the rows of a block stay in their order where they are read.
    placed = blocks.join(F.broadcast(starts.drop("_sound")), ["_f", "_p", "_b"], "left")
    rows = _staged(spark, placed.mapInArrow(E.elements(member), E.ELEMENTS), "envelope_elements", "zstd")
    single = rows.where(F.col("_n").isNull()).select(F.col("_text").cast("string").alias("record"))
    place = F.struct(F.length("_p").alias("_l"), "_p", "_b", "_n")
    so_far = Window.partitionBy("_f").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    several = rows.where(F.col("_n").isNotNull()).withColumn("_of", F.sum(F.col("_opens").cast("long")).over(so_far))
    joined = several.groupBy("_f", "_of").agg(
        F.max(F.when(F.col("_opens"), F.col("_mine"))).alias("_mine"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("_at"), F.col("_text").cast("string").alias("_t")))),
                                 lambda x: x["_t"]), "").alias("record"))
    record = F.col("record")
    return single.unionByName(joined.where("_mine").select("record")).select(
        F.when(record.contains("\n") | record.contains("\r"), F.translate(record, "\n\r", "  ")).otherwise(record).alias("record"))
