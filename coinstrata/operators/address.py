"""Address queries over confirmed outputs with the overlay of unconfirmed ones.

confirmed and pending have script_hash, txid, vout, value, height, coinbase (pending: height null); pending_spends has
prev_txid, prev_vout.  Each function answers for one script or, given several, for all of them in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coinstrata.functions.amounts import amount_text
from coinstrata.functions.hashing import after_prefix, has_prefix, prefix8
from coinstrata.functions.status import confirmations, mature
from coinstrata.functions.text import ROWS_MOST, TooLarge
from coinstrata.operators.bag import OUTPOINT, as_outpoint


def of_scripts(rows: DataFrame, scripts: list[str] | DataFrame | None) -> DataFrame:
    """Rows of the scripts (hex): a pushed filter for a list, a semi join for a table."""
    if scripts is None:
        return rows
    if isinstance(scripts, list):
        return rows.filter(F.col("script_hash").isin([bytes.fromhex(s) for s in scripts]))
    return rows.join(scripts.select("script_hash"), "script_hash", "left_semi")


def page(rows: DataFrame, limit: int | None, after: tuple[str, int] | None) -> DataFrame:
    """Rows strictly after the cursor in key order, at most limit.  The cursor is written out so that it is pushed."""
    if after:
        past = after_prefix(after[0])
        beyond = F.lit(False) if past is None else F.col("txid") >= F.unhex(F.lit(past))
        rows = rows.filter(beyond | (has_prefix(F.col("txid"), after[0]) & (F.col("vout") > after[1])))
    return rows.orderBy(prefix8(F.col("txid")), "vout").limit(limit) if limit else rows


def next_cursor(base: DataFrame, limit: int) -> DataFrame:
    """One row: the cursor after a full page of scanned rows, null after a short one."""
    last = F.max_by(F.struct(F.lower(F.hex(prefix8(F.col("txid")))).alias("t"), "vout"), F.struct(prefix8(F.col("txid")), "vout"))
    return base.agg(F.count("*").alias("n"), last.alias("l")).select(F.when(F.col("n") == limit, F.concat_ws(":", "l.t", "l.vout")).alias("next_cursor"))


def within_ceiling(rows: DataFrame, most: int = ROWS_MOST) -> DataFrame:
    """rows, or TooLarge if there are more than most; counts at most one more."""
    if rows.limit(most + 1).count() > most:
        raise TooLarge(f"more than {most} rows; ask page by page")
    return rows


def require_txid(rows: DataFrame) -> DataFrame:
    """rows; reading one without a whole transaction id fails."""
    return rows.withColumn("txid", F.when(F.octet_length("txid") == 32, F.col("txid")).otherwise(F.raise_error(F.lit("an output lacks its transaction id"))))


def unspent(confirmed: DataFrame, pending_spends: DataFrame) -> DataFrame:
    """Outputs that no unconfirmed transaction spends."""
    return confirmed.join(as_outpoint(pending_spends).select(*OUTPOINT), OUTPOINT, "left_anti")


def visible(confirmed: DataFrame, tip: int, maturity: int) -> DataFrame:
    """Rows with their confirmations, without those above the tip and immature coinbases."""
    rows = confirmed.withColumn("confirmations", confirmations(F.lit(tip), F.col("height")))
    return rows.filter((F.col("confirmations") >= 0) & mature(F.col("coinbase"), F.col("confirmations"), maturity))


def pending_only(pending: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Unconfirmed outputs that the confirmed ones don't hold yet."""
    return pending.join(confirmed.select(*OUTPOINT), OUTPOINT, "left_anti")


def utxos(confirmed: DataFrame, pending: DataFrame, pending_spends: DataFrame, tip: int, maturity: int, scripts=None, limit: int | None = None, after=None) -> DataFrame:
    """Unspent outputs: confirmed rows, then on the first or only page the unconfirmed ones.

    The page is cut before the filters, so it may hold fewer rows than limit; a confirmed row hides its unconfirmed copy
    even if it is filtered out itself.
    """
    base = require_txid(page(of_scripts(confirmed, scripts), limit, after))
    columns = ["script_hash", "txid", "vout", "value", "height", "coinbase", "confirmations"]
    rows = visible(unspent(base, pending_spends), tip, maturity).select(*columns, F.lit(0).alias("part"))
    if after is None:
        waiting = unspent(pending_only(require_txid(of_scripts(pending, scripts)), of_scripts(confirmed, scripts)), pending_spends)
        rows = rows.unionByName(waiting.withColumn("height", F.lit(None).cast("int")).withColumn("confirmations", F.lit(0)).select(*columns, F.lit(1).alias("part")))
    return rows.withColumn("amount", amount_text(F.col("value")))


def in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("part", prefix8(F.col("txid")), "vout")


def balance(rows: DataFrame) -> DataFrame:
    """Sum of an unpaged utxos() answer by script, as exact text."""
    return rows.groupBy("script_hash").agg(F.sum("value").cast("decimal(30,0)").alias("satoshis")).withColumn("balance", amount_text(F.col("satoshis")))


def info(confirmed: DataFrame, pending: DataFrame, pending_spends: DataFrame, scripts=None) -> DataFrame:
    """By script: confirmed, received and pending sums with their counts; no filter by maturity or tip."""
    spent = as_outpoint(pending_spends).select(*OUTPOINT).distinct().withColumn("spent", F.lit(True))
    zero = F.lit(0).cast("decimal(20,0)")
    a = of_scripts(confirmed, scripts).join(spent, OUTPOINT, "left").select("script_hash", F.col("value").alias("c"), F.when(F.col("spent"), -F.col("value")).otherwise(zero).alias("p"), F.lit(1).alias("cn"), F.lit(0).alias("pn"))
    b = pending_only(of_scripts(pending, scripts), of_scripts(confirmed, scripts)).join(spent, OUTPOINT, "left").select("script_hash", zero.alias("c"), F.when(F.col("spent"), zero).otherwise(F.col("value")).alias("p"), F.lit(0).alias("cn"), F.lit(1).alias("pn"))
    s = lambda c: F.sum(c).cast("decimal(30,0)")
    out = a.unionAll(b).groupBy("script_hash").agg(s("c").alias("confirmed"), s("p").alias("pending"), F.sum("cn").alias("confirmed_count"), F.sum("pn").alias("pending_count"))
    return out.withColumn("received", F.col("confirmed")).withColumn("confirmed_text", amount_text(F.col("confirmed"))).withColumn("pending_text", amount_text(F.col("pending")))


def select_coins(rows: DataFrame, target: int | Column, by: list[str] | None = None) -> DataFrame:
    """The largest outputs, by script if asked, until they reach the target."""
    order = [F.desc("value"), prefix8(F.col("txid")), "vout"]
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    target = F.lit(target) if isinstance(target, int) else target
    return rows.withColumn("running", F.sum("value").over(w).cast("decimal(30,0)")).filter(F.col("running") - F.col("value") < target)


def drain(confirmed: DataFrame, script: str, limit: int) -> tuple[int, DataFrame | None]:
    """What all pages of a script hold, one after the other, in a single read: (pages, rows)."""
    rows = of_scripts(confirmed, [script])
    return rows.count() // limit + 1, rows.orderBy(prefix8(F.col("txid")), "vout")
