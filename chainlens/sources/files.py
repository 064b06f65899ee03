"""Landed-file sources: order / returns / people sheets exported as CSV,
Parquet or JSON, the JSON record envelopes and the analytics document.

Sheets are read by header name (``Order ID`` becomes ``order_id``), in any
column order; columns that a file doesn't have stay absent, others are kept.
Every reader fails on malformed input instead of dropping or blanking rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainlens import schemas
from chainlens.functions.frames import fact_join
from chainlens.operators.transforms import enrich_orders, enrich_people, enrich_returns, normalise_doubles
from chainlens.sources.envelopes import envelope_records


def _sheet_schema(canonical: T.StructType) -> T.StructType:
    """Schema keyed by sheet headers, dates as text (coerced later)."""
    return T.StructType([T.StructField(schemas.CANONICAL_TO_SHEET.get(f.name, f.name),
                                       T.StringType() if isinstance(f.dataType, T.DateType) else f.dataType, True)
                         for f in canonical.fields])


def rename_headers(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(schemas.SHEET_HEADERS.get(c.strip(), c.strip())) for c in df.columns])


def _typed(df: DataFrame, canonical: T.StructType) -> DataFrame:
    """Text columns of the canonical names cast to their types; dates are
    coerced by the ingest transforms.  A value that can't be cast fails the job."""
    types = {f.name: f.dataType for f in canonical.fields if not isinstance(f.dataType, (T.DateType, T.StringType))}
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def read_landed(spark: SparkSession, path: str, canonical: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read a landed table by its header names.

    CSV takes one look at the header line; files of one folder must agree on
    it.  JSON takes one pass over the keys, so that a key no record has stays
    an absent column.  Envelopes (``fmt="envelope"``) of any size are cut into
    their records first, also if a folder holds the parts of one
    (``fmt="envelope_parts"``)."""
    if fmt == "csv":
        df = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    elif fmt in ("json", "envelope", "envelope_parts"):
        reader = spark.read.option("primitivesAsString", True).option("mode", "FAILFAST")
        if fmt == "json":
            df = reader.json(path)
        else:
            lines = envelope_records(spark, path, parts=fmt == "envelope_parts")
            text = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
            df = DataFrame(reader._jreader.json(text), spark)
    else:
        df = spark.read.parquet(path)
    return normalise_doubles(_typed(rename_headers(df), canonical))


def load_orders(spark: SparkSession, path: str, fmt: str = "csv", lenient: bool = False) -> DataFrame:
    return enrich_orders(read_landed(spark, path, schemas.ORDERS, fmt), lenient=lenient)


def load_returns(spark: SparkSession, path: str, fmt: str = "csv", lenient: bool = False) -> DataFrame:
    return enrich_returns(read_landed(spark, path, schemas.RETURNS, fmt), lenient=lenient)


def load_people(spark: SparkSession, path: str, fmt: str = "csv", lenient: bool = False) -> DataFrame:
    return enrich_people(read_landed(spark, path, schemas.PEOPLE, fmt), lenient=lenient)


def load_all(spark: SparkSession, paths: dict[str, str], fmt: str = "csv",
             formats: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Lazy DataFrames for whichever of orders / returns / people are given
    (``formats`` overrides ``fmt`` per table)."""
    loaders = {"orders": load_orders, "returns": load_returns, "people": load_people}
    formats = formats or {}
    return {name: loaders[name](spark, p, formats.get(name, fmt))
            for name, p in paths.items() if name in loaders}


# --- JSON envelopes -----------------------------------------------------------

STRICT = {"mode": "FAILFAST"}


def read_envelope(spark: SparkSession, path: str, row_schema: T.StructType,
                  multiline: bool = True, header_names: bool = True) -> DataFrame:
    """Unwrap ``{status, data: [rows], count}`` files into rows.

    A document that spans lines is parsed by one task, so feeds of any size
    should be landed as many files or as one document a line
    (``multiline=False``), which Spark splits.  ``inline`` turns the array
    into rows where it was parsed.  A broken document fails the job."""
    rs = _sheet_schema(row_schema) if header_names else row_schema
    env = spark.read.schema(schemas.envelope(rs)).option("multiLine", multiline).options(**STRICT).json(path)
    return normalise_doubles(rename_headers(env.select(F.inline("data"))))


def parse_envelope_column(df: DataFrame, text_col: str, row_schema: T.StructType) -> DataFrame:
    """Same unwrapping for envelopes held as text in a column."""
    parsed = df.select(F.from_json(F.col(text_col), schemas.envelope(row_schema), STRICT).alias("env"))
    return parsed.select(F.inline("env.data"))


def analytics_rows(doc: DataFrame) -> DataFrame:
    """Analytics document -> long rows (breakdown, key, total_sales)."""
    parts = [doc.select(F.lit(m).alias("breakdown"), F.explode(m).alias("key", "total_sales"))
             for m in ("regional_sales", "category_sales", "monthly_sales")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_analytics_doc(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return analytics_rows(spark.read.schema(schemas.ANALYTICS_DOC).option("multiLine", multiline)
                          .options(**STRICT).json(path))


def parse_analytics_column(df: DataFrame, text_col: str) -> DataFrame:
    return analytics_rows(df.select(F.from_json(F.col(text_col), schemas.ANALYTICS_DOC, STRICT).alias("d")).select("d.*"))


# --- source precedence and combination ----------------------------------------

def resolve_source(primary: DataFrame | None, fallback: DataFrame | None) -> DataFrame | None:
    """Plan-time choice: the primary table when present, else the fallback."""
    return primary if primary is not None else fallback


def combine_sources(primary: DataFrame, fallback: DataFrame, key: Sequence[str]) -> DataFrame:
    """Primary rows plus fallback rows whose key the primary lacks (NULL in
    a key equals NULL).

    The anti-join and the union are both distributed; column sets may
    differ (missing columns become NULL).
    """
    known = primary.select(*[F.col(k).alias(f"__{k}") for k in key])
    same = [fallback[k].eqNullSafe(known[f"__{k}"]) for k in key]
    extra = fact_join(fallback, known, same, "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)
