"""The vendor mart kept up to date without reading all facts again.

The mart is defined over ``orders LEFT JOIN returns``: a line counts once per
return row of its order, orders and return ids count once.  So a change of one
return changes the weight of lines that did not change, and a sum a category
can't be kept alone.  What is kept:

* lines per (category, order): sums and the number of rows,
* returns per (order, return id): the number of rows,
* the mart's weighted sums per category.

All of the first two are sums, so a batch of inserted (+1) and deleted (-1) rows
is reduced to signed sums and added as a run of its own; the state of an order
is the sum over the runs.  The numbers of rows are reference counts: an order or
return id counts while its number is above 0.  A batch takes the orders that it
touches, works out their share of the mart before and after, and adds the
difference to the weighted sums.  So its work grows with the batch and with the
state read for its orders, not with the facts.

Runs of one level are summed up FANOUT at a time, and rows that came to nothing
are dropped.  A batch is published by one rename with its number; a batch that
is done again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.functions import columns as C
from chainlens.functions.frames import fact_join
from chainlens.operators.marts import _with_category
from chainlens.sources.snapshots import MIN_AGE_S, Snapshots

FANOUT = 8
SIGN = "_sign"
LINE_KEY, LINE_SUMS = ["category", "order_id"], ["rows", "s_sales", "n_sales", "s_profit", "n_profit", "s_lead", "n_lead", "s_ov", "n_ov"]
RETURN_KEY, RETURN_SUMS = ["order_id", "return_id"], ["rows"]
MART_SUMS = ["lines", "orders", "lead", "n_lead", "ov", "n_ov", "sales", "n_sales", "profit", "n_profit", "ids"]
EXACT = "decimal(38,8)"


def _signed_lines(lines: DataFrame, dim_products: DataFrame, skew_share: float | None) -> DataFrame:
    """Signed sums per (category, order) of line rows with a ``_sign`` of +1 or -1."""
    d, sign = _with_category(lines, dim_products, skew_share), F.col(SIGN).cast("long")

    def money(c: str) -> Column:
        return F.coalesce(F.sum(C.money(c) * F.col(SIGN).cast("decimal(1,0)")), F.lit(0)).cast(EXACT)

    def present(c: str) -> Column:
        return F.sum(F.when(F.col(c).isNotNull(), sign).otherwise(0))

    return d.groupBy(*LINE_KEY).agg(
        F.sum(sign).alias("rows"), money("sales").alias("s_sales"), present("sales").alias("n_sales"),
        money("profit").alias("s_profit"), present("profit").alias("n_profit"),
        F.coalesce(F.sum(F.col("lead_time_days") * sign), F.lit(0)).cast("long").alias("s_lead"),
        present("lead_time_days").alias("n_lead"), money("order_value").alias("s_ov"), present("order_value").alias("n_ov"))


def _signed_returns(returns: DataFrame) -> DataFrame:
    return (returns.where(F.col("order_id").isNotNull()).groupBy(*RETURN_KEY)
            .agg(F.sum(F.col(SIGN).cast("long")).alias("rows")))


def _by_key(rows: DataFrame) -> DataFrame:
    """Rows with ``_k`` instead of order_id: one text that is never NULL (a NULL order is an order too)."""
    return rows.withColumn("_k", F.coalesce(F.concat(F.lit("="), "order_id"), F.lit(""))).drop("order_id")


def _two_states(rows: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Per key the state after the batch (a_) and before it (b_), the sums of all runs and of the
    ``_old`` ones; a state without a row left is NULL."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    total = lambda c, only: F.sum(only(F.col(c))).cast(kinds[c])
    d = rows.groupBy(*key).agg(*[total(c, lambda v: v).alias(f"a_{c}") for c in sums],
                               *[total(c, lambda v: F.when(F.col("_old"), v)).alias(f"b_{c}") for c in sums])
    return d.select(*key, *[F.when(F.col(f"{x}_rows") != 0, F.col(f"{x}_{c}")).alias(f"{x}_{c}") for x in "ab" for c in sums])


def _mart_sums(lines: DataFrame, returns: DataFrame) -> DataFrame:
    """MART_SUMS per category, a row for the state after the batch and one with the negated sums before
    it.  Both inputs are dealt out by ``_k``, and so are all steps up to the sums a category."""
    lines = _two_states(lines, ["_k", "category"], LINE_SUMS)
    per_order = _two_states(returns, ["_k", "return_id"], RETURN_SUMS).groupBy(F.col("_k").alias("_o")).agg(
        *[e for x in "ab" for e in (F.sum(f"{x}_rows").alias(f"{x}_m"),
                                    F.count(F.when(F.col(f"{x}_rows").isNotNull(), F.col("return_id"))).alias(f"{x}_ids"))])
    j = fact_join(lines, per_order, lines["_k"] == per_order["_o"], "left")

    def sums(x: str) -> list[Column]:
        c = lambda name: F.col(f"{x}_{name}")
        here, m = c("rows").isNotNull(), F.coalesce(c("m"), F.lit(1))
        values = {"lines": c("rows"), "orders": (here & (F.col("_k") != "")).cast("long"), "lead": c("s_lead") * m,
                  "n_lead": c("n_lead") * m, "ov": C.weighted(c("s_ov"), m), "n_ov": c("n_ov") * m,
                  "sales": C.weighted(c("s_sales"), m), "n_sales": c("n_sales"), "profit": C.weighted(c("s_profit"), m),
                  "n_profit": c("n_profit"), "ids": F.when(here, c("ids"))}
        return [F.coalesce(F.sum(values[n]), F.lit(0)).cast(EXACT if n in _MONEY else "long").alias(f"{x}_{n}") for n in MART_SUMS]

    def row(x: str) -> Column:
        sign = (lambda c: c) if x == "a" else (lambda c: -c)
        return F.struct(*[sign(F.col(f"{x}_{n}")).cast(EXACT if n in _MONEY else "long").alias(n) for n in MART_SUMS])

    return j.groupBy("category").agg(*sums("a"), *sums("b")).select("category", F.inline(F.array(row("a"), row("b"))))


def _mart(sums: DataFrame) -> DataFrame:
    """The mart's columns from its weighted sums; a category without a line has no row."""
    money = lambda c: C.money_round(F.when(F.col(f"n_{c}") > 0, F.col(c)))
    orders = F.col("orders")
    return sums.where("lines > 0").select(
        "category", orders.alias("total_orders"),
        C.ratio_round(F.try_divide(F.col("lead").cast("double"), F.col("n_lead").cast("double"))).alias("avg_lead_time"),
        C.money_round(F.try_divide(F.col("ov").cast("double"), F.col("n_ov").cast("double"))).alias("avg_order_value"),
        money("sales").alias("total_sales"), money("profit").alias("total_profit"), F.col("ids").alias("total_returns"),
        C.ratio_round(F.when(orders > 0, F.col("ids") / orders).otherwise(F.lit(0.0))).alias("return_rate"))


def apply_batch(spark: SparkSession, path: str, batch_id: int, lines: DataFrame, returns: DataFrame, dim_products: DataFrame,
                skew_share: float | None = None, fanout: int = FANOUT, min_age_s: float = MIN_AGE_S) -> None:
    """Bring a batch of fact_orders and fact_returns rows, each with a ``_sign`` of +1 (inserted) or
    -1 (deleted), into the mart state at ``path``.  A product keeps its category; a product that
    changes it is deleted and inserted again line by line."""
    log = Snapshots(spark, path)
    version, content = log.read()
    content = content or {"batch": -1, "runs": [], "sums": None}
    if batch_id <= content["batch"]:
        return
    run = log.folder("run")
    _signed_lines(lines, dim_products, skew_share).write.parquet(f"{run}/lines", compression="zstd")
    _signed_returns(returns).write.parquet(f"{run}/returns", compression="zstd")
    new = {"folder": run.rsplit("/", 1)[1], "level": 0}
    names = [r["folder"] for r in content["runs"]]

    def rows(of: str) -> DataFrame:
        return _by_key(_read(spark, path, [new["folder"]], of)).withColumn("_old", F.lit(False))

    lines_of, returns_of = rows("lines"), rows("returns")
    if names:
        lines_of.select("_k").unionByName(returns_of.select("_k")).distinct().write.parquet(f"{run}/orders", compression="zstd")
        orders = spark.read.schema("_k string").parquet(f"{run}/orders")

        def touched(of: str, own: DataFrame) -> DataFrame:
            """Rows of the touched orders.  This join deals them out for all steps that follow."""
            before = _by_key(_read(spark, path, names, of)).withColumn("_old", F.lit(True))
            return fact_join(before.unionByName(own), orders, "_k", "left_semi")

        lines_of, returns_of = touched("lines", lines_of), touched("returns", returns_of)
    else:
        lines_of, returns_of = lines_of.repartition("_k"), returns_of.repartition("_k")
    changes = _mart_sums(lines_of, returns_of)
    if names:
        changes = changes.unionByName(_read(spark, path, [content["sums"]], "sums"))
    kinds = {c: EXACT if c in _MONEY else "long" for c in MART_SUMS}
    (changes.groupBy("category").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in MART_SUMS]).write.parquet(f"{run}/sums"))
    content = {"batch": batch_id, "runs": content["runs"] + [new], "sums": new["folder"]}
    version = log.publish(content, version)
    while len(content["runs"]) >= fanout and len({r["level"] for r in content["runs"][-fanout:]}) == 1:
        rest, last = content["runs"][:-fanout], content["runs"][-fanout:]
        merged = log.folder("run")
        for of, key, sums in (("lines", LINE_KEY, LINE_SUMS), ("returns", RETURN_KEY, RETURN_SUMS)):
            rows = _read(spark, path, [r["folder"] for r in last], of)
            d = rows.groupBy(*key).agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums])
            d.where(" OR ".join(f"{c} <> 0" for c in sums)).write.parquet(f"{merged}/{of}")
        content = content | {"runs": rest + [{"folder": merged.rsplit("/", 1)[1], "level": last[0]["level"] + 1}]}
        version = log.publish(content, version)
    log.expire(min_age_s=min_age_s)


_MONEY = {"s_sales", "s_profit", "s_ov", "ov", "sales", "profit"}


def _read(spark: SparkSession, path: str, folders: list[str], of: str) -> DataFrame:
    keys, sums = {"lines": (LINE_KEY, LINE_SUMS), "returns": (RETURN_KEY, RETURN_SUMS), "sums": (["category"], MART_SUMS)}[of]
    schema = ", ".join([f"{k} string" for k in keys] + [f"{c} {EXACT if c in _MONEY else 'long'}" for c in sums])
    return spark.read.schema(schema).parquet(*[f"{path}/{f}/{of}" for f in folders])


def read_mart(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """mart_vendor_performance as of the last batch, or as of a version."""
    _, content = Snapshots(spark, path).read(version)
    if content is None:
        raise FileNotFoundError(f"no batch was brought into {path}")
    return _mart(_read(spark, path, [content["sums"]], "sums"))
