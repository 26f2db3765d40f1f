"""Key lookups: overwrite joins, anti and semi joins, insert-if-absent and upsert, the member normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import parse_date


def last_by_key(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the greatest ``version`` of each key, picked by an aggregate that combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row"))
    return picked.select(*keys, *(F.col(f"row.`{c}`") for c in rest))


def lookup_overwrite(left: DataFrame, right: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Left outer lookup whose fields, where a match is found, overwrite equal-named ones; every left row stays one row.

    Of repeated right keys the one with the greatest ``version`` wins, or without one, since a table has no order of its
    own, the greatest row by its columns in turn.
    """
    if version:
        right = last_by_key(right, [key], version).drop(version)
    else:
        rest = [c for c in right.columns if c != key]
        right = right.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, *(F.col(f"_row.`{c}`") for c in rest))
    r = right.select(F.col(key).alias("_k"), F.struct(*(F.col(c) for c in right.columns if c != key)).alias("_r"))
    joined = left.join(r, F.col(key) == F.col("_k"), "left")
    fields = [c for c in right.columns if c != key]
    old = [F.when(F.col("_k").isNotNull(), F.col(f"_r.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in left.columns]
    new = [F.col(f"_r.`{c}`").alias(c) for c in fields if c not in left.columns]
    return joined.select(*old, *new)


def new_keys(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is neither null nor stored; of repeated incoming keys one stays."""
    fresh = incoming.dropna(subset=list(keys)).dropDuplicates(list(keys))
    return fresh.join(stored.select(*keys), list(keys), "left_anti")


def known_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other.select(*keys), list(keys), "left_semi")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored table with the incoming rows in place of those of equal keys. Write it to another path than ``stored``'s."""
    return stored.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming)


def matching_null_keys(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows without a stored counterpart, where null equals null."""
    a, b = incoming.alias("a"), stored.select(*keys).alias("b")
    on = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    return a.join(b, on, "left_anti")


def upsert_children(stored: dict[str, DataFrame], incoming: dict[str, DataFrame], keys: dict[str, Sequence[str]], parent: str) -> dict[str, DataFrame]:
    """What to append or replace per table: the parent's rows replace those of equal keys, a child's rows are kept only where
    no stored child has equal keys, null being equal to null. Without a stored table all incoming rows are new."""
    out = {}
    for name, rows in incoming.items():
        have, on = stored.get(name), keys[name]
        if have is None:
            out[name] = rows
        elif name == parent:
            out[name] = upsert(have, rows, on)
        else:
            out[name] = matching_null_keys(rows, have, on)
    return out


def normalise_members(payload: DataFrame, record: str = "member") -> dict[str, DataFrame]:
    """Nested member records as four linked tables; child rows are keyed by what identifies them in the source."""
    m = payload.select(F.col(f"{record}.*"))
    members = m.select(
        F.col("pId").cast("string").alias("pId"), "memberCode", "firstName", "fullName", "showAs", "gender", parse_date(F.col("dateOfDeath")).alias("dateOfDeath")
    ).where("pId is not null")
    stays = m.select(F.col("pId").cast("string").alias("pId"), F.explode("memberships.membership").alias("s")).where("pId is not null")
    stays = stays.select(
        "pId", F.col("s.house.houseCode").alias("houseCode"), F.col("s.house.houseNo").cast("int").alias("houseNo"),
        parse_date(F.col("s.dateRange.start")).alias("membership_start_date"), parse_date(F.col("s.dateRange.end")).alias("membership_end_date"),
        F.col("s.uri").alias("membership_uri"), F.col("s.parties.party").alias("parties"), F.col("s.represents.represent").alias("represents"),
    )
    # the surrogate key is a function of the natural one, so a second load gives the same
    stays = stays.withColumn("membership_id", F.xxhash64("pId", F.coalesce("membership_uri", F.concat_ws("|", "houseCode", F.col("houseNo").cast("string"), F.col("membership_start_date").cast("string")))))
    parties = stays.select("membership_id", F.explode("parties").alias("p")).select(
        "membership_id", F.col("p.partyCode").alias("partyCode"), F.col("p.showAs").alias("party_showAs"), parse_date(F.col("p.dateRange.start")).alias("party_start_date"), parse_date(F.col("p.dateRange.end")).alias("party_end_date")
    )
    places = stays.select("membership_id", F.explode("represents").alias("r")).select(
        "membership_id", F.col("r.representCode").alias("representCode"), F.col("r.showAs").alias("representShowAs"), F.col("r.representType").alias("representType")
    )
    return {
        "members": members.dropDuplicates(["pId"]),
        "memberships": stays.drop("parties", "represents").dropDuplicates(["membership_id"]),
        "parties": parties.dropDuplicates(["membership_id", "partyCode", "party_start_date"]),
        "representations": places.dropDuplicates(["membership_id", "representCode"]),
    }
