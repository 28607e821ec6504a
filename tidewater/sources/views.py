"""The lending domain as views over the star-schema tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.numeric import exact


#: Rows of the largest table that one task of a shuffle holds, about.
TASK_ROWS = 250_000
#: So many times as many lines of one asset are dealt to several tasks.
HEAVY = 4
#: Assets are counted by buckets, so that the counting holds no more where there are more assets.
BUCKETS = 65_536


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks a shuffle of all lines, positions or assets needs, so that a task's memory doesn't grow with the
    input. Adaptive execution sizes tasks by compressed bytes, and these rows grow more than twentyfold in memory. Files'
    footers give the number of rows."""
    rows = max(table(spark, sf_dir, name).count() for name in ("lineitem", "orders", "part"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """A side of a join that has about one row a key, dealt to n tasks by it and hashed there: neither side is sorted,
    and each sort would hold all of a task's rows."""
    return df.repartition(n, *keys).hint("shuffle_hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, symbol, price, max_ltv, max_borrow_ltv, rate, stable, kind"""
    big = F.col("p_size") > 25
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asset"), F.col("p_name").alias("symbol"), exact(F.col("p_retailprice"), 2).alias("price"),
        F.when(big, F.lit("0.6")).otherwise("0.8").cast("decimal(4,2)").alias("max_ltv"), F.when(big, F.lit("0.45")).otherwise("0.65").cast("decimal(4,2)").alias("max_borrow_ltv"),
        (F.col("p_size").cast("decimal(6,0)") / F.lit(1000).cast("decimal(5,0)")).cast("decimal(6,3)").alias("rate"), (F.col("p_type") == "ECONOMY").alias("stable"), F.col("p_type").alias("kind"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position_id, asset, amount"""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("position_id"), F.col("l_partkey").alias("asset"), exact(F.col("l_quantity"), 2).alias("amount"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("asset"), F.lit(BUCKETS))


def _heavy(lines: DataFrame) -> DataFrame | None:
    """_bucket, _shares: buckets of assets (by hash) that more lines name than one task should hold, and over how many
    tasks they go; None without any. There are at most rows / TASK_ROWS of them."""
    most = HEAVY * TASK_ROWS
    if lines.count() <= most:
        return None
    counts = lines.groupBy(_bucket().alias("_bucket")).count().filter(F.col("count") > most).select("_bucket", F.ceil(F.col("count") / TASK_ROWS).alias("_shares"))
    rows = counts.collect()
    return lines.sparkSession.createDataFrame(rows, counts.schema) if rows else None


def priced(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """position_id, asset, amount and the asset's columns: one row per position and asset, dealt to n tasks by asset. An
    asset that very many lines name goes to several tasks, by position, and its row to each of them."""
    lines, sides, keys = _lines(spark, sf_dir), assets(spark, sf_dir), ["asset"]
    heavy = _heavy(lines)
    if heavy is not None:
        shares = lambda df: df.withColumn("_bucket", _bucket()).join(F.broadcast(heavy), "_bucket", "left").withColumn("_shares", F.coalesce("_shares", F.lit(1)))
        lines = shares(lines).withColumn("_share", F.pmod(F.xxhash64("position_id"), "_shares")).drop("_bucket", "_shares")
        sides = shares(sides).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_bucket", "_shares")
        keys = ["asset", "_share"]
    held = lines.repartition(n, *keys).groupBy("position_id", *keys).agg(F.sum("amount").alias("amount"))
    return held.join(dealt(sides, n, *keys), keys, "left").drop("_share")


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, position_id, asset, amount: one row per position and asset"""
    n = tasks(spark, sf_dir)
    held = _lines(spark, sf_dir).repartition(n, "position_id").groupBy("position_id", "asset").agg(F.sum("amount").alias("amount"))
    return held.join(users(spark, sf_dir, n), "position_id").select("user", "position_id", "asset", "amount")


def users(spark: SparkSession, sf_dir: str, n: int, *columns: str) -> DataFrame:
    """position_id, user and other columns of positions; dealt to n tasks by position_id"""
    return dealt(positions(spark, sf_dir).select("position_id", "user", *columns), n, "position_id")


def debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position_id, debt; dealt by position_id"""
    return dealt(positions(spark, sf_dir).select("position_id", "debt"), tasks(spark, sf_dir), "position_id")


def positions(spark: SparkSession, sf_dir: str, debt_factor: str = "0.1") -> DataFrame:
    """position_id, user, debt, opened"""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position_id"), F.col("o_custkey").alias("user"), (exact(F.col("o_totalprice"), 2) * F.lit(debt_factor).cast("decimal(3,2)")).cast("decimal(20,4)").alias("debt"), F.col("o_orderdate").alias("opened"))


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings with the asset's columns and value; an asset without a price is worth 0. The shared core of the
    position reports: two equality joins, neither of which sorts. Lines are dealt by asset and then by position, which joins and groupings by
    position need no third time."""
    n = tasks(spark, sf_dir)
    rows = priced(spark, sf_dir, n).withColumn("value", F.coalesce((F.col("amount") * F.col("price")).cast("decimal(28,4)"), F.lit(0).cast("decimal(28,4)")))
    held = rows.repartition(n, "position_id").join(users(spark, sf_dir, n), "position_id")
    return held.select("asset", "user", "position_id", *(c for c in rows.columns if c not in ("asset", "position_id")))


def queue_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, asset, ltv, borrow_ltv, tvl: deposits queued by the loan-to-value at which they absorb losses"""
    key = F.col("s_suppkey")
    ltv = ((key % 30 + 60).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")).cast("decimal(4,2)")
    borrow = ((key % 20 + 40).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")).cast("decimal(4,2)")
    return table(spark, sf_dir, "supplier").select(key.alias("slot"), F.col("s_nationkey").alias("asset"), ltv.alias("ltv"), borrow.alias("borrow_ltv"), exact(F.greatest("s_acctbal", F.lit(0.0)), 2).alias("tvl"))


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deposit_id, user, amount, lock_days, day, perpetual, unstaking"""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(o.alias("deposit_id"), F.col("o_custkey").alias("user"), exact(F.col("o_totalprice"), 2).alias("amount"), (o % 365).cast("long").alias("lock_days"), F.col("o_orderdate").alias("day"), (o % 11 == 0).alias("perpetual"), (o % 7 == 0).alias("unstaking"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, series, market, kind, ts, value, props"""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("series"), (F.col("user_id") % 10).alias("market"), F.col("event_type").alias("kind"), "ts", exact(F.col("value"), 2).alias("value"), "props")


#: The same views for the SQL side.
SQL = {
    "assets": """SELECT p_partkey AS asset, p_name AS symbol, p_retailprice::DECIMAL(18,2) AS price, (CASE WHEN p_size > 25 THEN 0.6 ELSE 0.8 END)::DECIMAL(4,2) AS max_ltv,
      (CASE WHEN p_size > 25 THEN 0.45 ELSE 0.65 END)::DECIMAL(4,2) AS max_borrow_ltv, (p_size * 0.001)::DECIMAL(6,3) AS rate, p_type = 'ECONOMY' AS stable, p_type AS kind FROM part""",
    "positions": "SELECT o_orderkey AS position_id, o_custkey AS \"user\", (o_totalprice::DECIMAL(18,2) * 0.1::DECIMAL(3,2))::DECIMAL(20,4) AS debt, o_orderdate AS opened FROM orders",
    "holdings": "SELECT \"user\", l_orderkey AS position_id, l_partkey AS asset, sum(l_quantity::DECIMAL(18,2)) AS amount FROM lineitem JOIN positions ON position_id = l_orderkey GROUP BY ALL",
    "valued": "SELECT h.*, a.* EXCLUDE (asset), coalesce((amount * price)::DECIMAL(28,4), 0) AS value FROM holdings h LEFT JOIN assets a USING (asset)",
    "slots": """SELECT s_suppkey AS slot, s_nationkey AS asset, ((s_suppkey % 30 + 60) * 0.01)::DECIMAL(4,2) AS ltv, ((s_suppkey % 20 + 40) * 0.01)::DECIMAL(4,2) AS borrow_ltv,
      greatest(s_acctbal, 0)::DECIMAL(18,2) AS tvl FROM supplier""",
    "deposits": "SELECT o_orderkey AS deposit_id, o_custkey AS \"user\", o_totalprice::DECIMAL(18,2) AS amount, o_orderkey % 365 AS lock_days, o_orderdate AS day, o_orderkey % 11 = 0 AS perpetual, o_orderkey % 7 = 0 AS unstaking FROM orders",
    "ev": "SELECT event_id, user_id AS series, user_id % 10 AS market, event_type AS kind, ts, value::DECIMAL(18,2) AS value, props FROM events",
}
_NEEDS = {"holdings": ["positions"], "valued": ["positions", "holdings", "assets"]}


def sql_with(names: str, body: str) -> str:
    """A query over the named views."""
    wanted: list[str] = []
    for name in names.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in wanted:
                wanted.append(need)
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    return f"WITH {views}, {body.strip()[5:]}" if body.strip().startswith("WITH ") else f"WITH {views} {body}"
