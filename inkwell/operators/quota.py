"""Export quota: each attempt is accepted or denied in order, and only accepted ones use up the limits of their device and address."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

# Formats that can be exported, and the limits of a device for ever, an address for a day and an account for ever.
FORMATS = ("docx", "pdf")
DEVICE, ADDRESS, ACCOUNT = 1, 3, 100


def accepted(attempts: DataFrame, device: int = DEVICE, address: int = ADDRESS) -> DataFrame:
    """Ids of the anonymous attempts that both limits let through. attempts: id, device_id, ip, created_at.

    Whether an attempt passes depends on which earlier ones of its device and of its address that day passed, and so on through the graph
    of devices and addresses. No component of it is gathered: in each round an attempt passes if even all undecided ones before it would
    leave room, and is denied if those that passed before it leave none; denied ones drop out. The earliest undecided one is decided
    in any case, so rounds end. Used-up limits stay used up, so of one device, address and day only the first few can pass: the others go
    before the first round, within the tasks that read them.
    """
    order = ("created_at", "id")
    rows = attempts.select("id", "device_id", "ip", "created_at", F.to_date("created_at").alias("day"))
    same = Window.partitionBy("device_id", "ip", "day").orderBy(*order)
    rows = rows.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= min(device, address)).drop("rn").withColumn("passed", F.lit(False))
    earlier = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    of_device, of_address = earlier("device_id"), earlier("ip", "day")
    used = lambda w: F.coalesce(F.sum(F.col("passed").cast("int")).over(w), F.lit(0))
    while True:
        rows = rows.select("*", used(of_device).alias("d"), F.count("*").over(of_device).alias("d_most"), used(of_address).alias("a"), F.count("*").over(of_address).alias("a_most"))
        rows = rows.where(F.col("passed") | ((F.col("d") < device) & (F.col("a") < address)))
        rows = rows.withColumn("passed", F.col("passed") | ((F.col("d_most") < device) & (F.col("a_most") < address))).drop("d", "d_most", "a", "a_most")
        rows = stored(rows, "quota")
        if rows.where(~F.col("passed")).isEmpty():
            return rows.select("id")


def decide(attempts: DataFrame, accounts: DataFrame, maintenance: bool = False, unlimited: bool = False) -> DataFrame:
    """id, kind (user or anon) and verdict of each attempt: ok, INVALID, MAINTENANCE, AUTH_REQUIRED, DISABLED or QUOTA_EXCEEDED.

    attempts: id (unique), user_id, device_id, ip, format, check_only, created_at; accounts: id (unique), status, exports (used before).
    Attempts that only check are answered ok and use up nothing. An anonymous attempt without device or address is INVALID, as is an
    unknown format. A null in check_only means false; a null time is the earliest.
    """
    account = accounts.select(F.col("id").alias("user_id"), "status", "exports", F.lit(True).alias("known"))
    kind = F.when(F.col("user_id").isNotNull(), "user").otherwise("anon")
    rows = attempts.join(account, "user_id", "left").withColumn("kind", kind).withColumn("asks", F.coalesce("check_only", F.lit(False)))
    missing = F.coalesce(F.col("device_id").cast("string"), F.lit("")) == ""
    missing = missing | (F.coalesce(F.col("ip").cast("string"), F.lit("")) == "")
    early = (
        F.when(~F.coalesce(F.col("format").isin(*FORMATS), F.lit(False)), "INVALID")
        .when(F.lit(maintenance), "MAINTENANCE")
        .when((F.col("kind") == "user") & (F.col("known").isNull() | (F.col("status") == "deleted")), "AUTH_REQUIRED")
        .when((F.col("kind") == "user") & (F.col("status") == "disabled"), "DISABLED")
        .when((F.col("kind") == "anon") & missing, "INVALID")
        .when(F.col("asks") | ((F.col("kind") == "user") & F.lit(unlimited)), "ok")
    )
    rows = rows.withColumn("early", early)
    open_ = rows.where("early IS NULL")
    # an account's limit stands alone, so its first attempts pass
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id"))
    users = open_.where("kind = 'user'").withColumn("place", place).where(F.col("place") <= ACCOUNT - F.coalesce("exports", F.lit(0))).select("id")
    passed = users.unionByName(accepted(open_.where("kind = 'anon'"))).withColumn("passed", F.lit(True))
    return rows.join(passed, "id", "left").select("id", "kind", F.coalesce("early", F.when(F.col("passed"), "ok"), F.lit("QUOTA_EXCEEDED")).alias("verdict"))
