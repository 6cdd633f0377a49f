"""User identity: lookup by name or email, and checked import of new users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions.text import ascii_lower, is_email, strip_or_empty
from quizlake.operators.keys import assign_ids
from quizlake.session import cut_lineage

# Fixed values.
FOUND, BLANK, NOT_FOUND = "found", "blank", "not_found"
ACCEPTED = "Account created successfully! You can now login."
NAME_MISSING = "Username and password required."
BAD_EMAIL = "Invalid email format."
NAME_TAKEN = "Username already exists."
EMAIL_TAKEN = "Email already registered."


def identity_directory(users: DataFrame) -> DataFrame:
    """One row per folded identifier, name or email, with the smallest user id bearing it."""
    identifiers = F.array(ascii_lower(F.col("username")), ascii_lower(F.col("email")))
    return (
        users.select("user_id", F.explode(identifiers).alias("folded"))
        .filter(F.col("folded").isNotNull())
        .groupBy("folded")
        .agg(F.min("user_id").alias("user_id"))
    )


def resolve_identifiers(lookups: DataFrame, users: DataFrame) -> DataFrame:
    """Match lookup_id, identifier to a user by name or email, whatever the case.

    The either-or condition would plan as a nested loop; exploded to one identifier per row
    it is an equi-join. Blank identifiers match nothing and stay out of the join, where they
    would all share one partition.
    """
    cleaned = lookups.select(
        "lookup_id", ascii_lower(strip_or_empty(F.col("identifier"))).alias("folded")
    )
    asked = cleaned.filter(F.col("folded") != "")
    resolved = asked.join(identity_directory(users), "folded", "left").select(
        "lookup_id",
        "user_id",
        F.when(F.col("user_id").isNotNull(), FOUND).otherwise(NOT_FOUND).alias("status"),
    )
    blank = cleaned.filter(F.col("folded") == "").select(
        "lookup_id", F.lit(None).cast("bigint").alias("user_id"), F.lit(BLANK).alias("status")
    )
    return resolved.unionByName(blank)


def _first_two(open_rows: DataFrame, key: str) -> DataFrame:
    """Of every key its two earliest rows, and whom the later one follows; a hot key is limited before the shuffle."""
    in_order = Window.partitionBy(key).orderBy("seq")
    return (
        open_rows.select("seq", key)
        .withColumns({f"{key}_place": F.row_number().over(in_order), f"{key}_rival": F.min("seq").over(in_order)})
        .filter(F.col(f"{key}_place") <= 2)
        .drop(key)
    )


def _links(open_rows: DataFrame) -> DataFrame:
    """Rows with at most one earlier rival: seq, the rival as ``to`` (null for none), and ``odd``.

    A row without an earlier rival is accepted. A row with one is accepted if that rival is not.
    """
    both = _first_two(open_rows, "username").join(_first_two(open_rows, "email"), "seq")
    by_name, by_email = F.col("username_place") == 2, F.col("email_place") == 2
    two_rivals = by_name & by_email & (F.col("username_rival") != F.col("email_rival"))
    to = F.when(by_name, F.col("username_rival")).when(by_email, F.col("email_rival"))
    return both.filter(~two_rivals).select("seq", to.alias("to")).withColumn("odd", F.col("to").isNotNull())


def _settled(links: DataFrame) -> DataFrame:
    """seq of the rows that the links decide to accept.

    Each step lets every link follow the link it points at, so a chain of n rivals takes log(n)
    steps. What ends at a row without a rival is accepted after an even number of links; what ends at
    a row with several rivals stays open.
    """
    while True:
        ahead = links.filter(F.col("to").isNotNull()).select(
            F.col("seq").alias("to"), F.col("to").alias("further"), F.col("odd").alias("odd_ahead")
        )
        if not links.join(ahead, "to", "left_semi").limit(1).count():
            break
        links = cut_lineage(
            links.join(ahead, "to", "left").select(
                "seq",
                F.coalesce("further", "to").alias("to"),
                (F.col("odd") != F.coalesce("odd_ahead", F.lit(False))).alias("odd"),
            )
        )
    roots = links.filter(F.col("to").isNull()).select("seq")
    even = links.filter(~F.col("odd") & F.col("to").isNotNull())
    return roots.unionByName(even.join(roots.select(F.col("seq").alias("to")), "to", "left_semi").select("seq"))


def _without_keys_of(rows: DataFrame, taken: DataFrame) -> DataFrame:
    return rows.join(taken.select("username"), "username", "left_anti").join(
        taken.select("email"), "email", "left_anti"
    )


def _accept(open_rows: DataFrame) -> DataFrame:
    """The rows a one-by-one insert would accept.

    Each round settles all rows that depend on one earlier rival at most, directly or along a
    chain, accepts what that decides and drops what it blocks; a row that was itself dropped blocks nobody.
    A chain, however long, is settled in one round of log(length) steps; every round decides at
    least the earliest open row of each cluster of rivals.
    """
    open_rows = cut_lineage(open_rows.select("seq", "username", "email"))
    accepted = []
    while open_rows.limit(1).count():
        chosen = _settled(cut_lineage(_links(open_rows)))
        winners = cut_lineage(open_rows.join(chosen, "seq", "left_semi"))
        accepted.append(winners)
        open_rows = cut_lineage(
            _without_keys_of(open_rows, winners).select("seq", "username", "email")
        )
    return reduce(DataFrame.unionByName, accepted, open_rows)


def import_users(batch: DataFrame, users: DataFrame) -> DataFrame:
    """Check new users (seq, username, email) in arrival order against each other and ``users``.

    Returns seq, cleaned username and email, accepted and the message of a one-by-one
    registration: a taken name is reported before a taken email.
    """
    cleaned = batch.select(
        "seq",
        strip_or_empty(F.col("username")).alias("username"),
        F.lower(strip_or_empty(F.col("email"))).alias("email"),
    ).withColumn(
        "refusal",
        F.when(F.col("username") == "", NAME_MISSING).when(~is_email(F.col("email")), BAD_EMAIL),
    )
    refused = cleaned.filter(F.col("refusal").isNotNull())
    valid = cleaned.filter(F.col("refusal").isNull()).drop("refusal")
    accepted = _accept(_without_keys_of(valid, users))

    # A name is taken for a row if a stored user has it or a row accepted earlier.
    taken = (
        users.select("username", F.lit(None).cast("bigint").alias("seq"))
        .unionByName(accepted.select("username", "seq"))
        .groupBy("username")
        .agg(F.min(F.coalesce("seq", F.lit(-(2**63)))).alias("taken_at"))
    )
    verdicts = (
        valid.join(
            accepted.select("seq", F.lit(True).alias("won")), "seq", "left"
        )
        .join(taken, "username", "left")
        .select(
            "seq",
            "username",
            "email",
            F.coalesce("won", F.lit(False)).alias("accepted"),
            F.when(F.col("won"), ACCEPTED)
            .when(F.col("taken_at") < F.col("seq"), NAME_TAKEN)
            .otherwise(EMAIL_TAKEN)
            .alias("message"),
        )
    )
    return verdicts.unionByName(
        refused.select(
            "seq", "username", "email", F.lit(False).alias("accepted"), F.col("refusal").alias("message")
        )
    )


def imported_users(verdicts: DataFrame, users: DataFrame, run_time: str) -> DataFrame:
    """User rows of the accepted ``verdicts`` of ``import_users``, ids above the stored ones."""
    new = verdicts.filter("accepted").select("seq", "username", "email")
    return assign_ids(new, "user_id", ["seq"], existing=users).select(
        "user_id",
        "username",
        "email",
        F.to_timestamp_ntz(F.lit(run_time)).alias("created_at"),
        F.lit(1).alias("email_verified"),
    )
