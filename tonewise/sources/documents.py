"""Stored documents without a fixed schema: parsed once as variants, each field read in all shapes it comes in.

Nothing here fails on a value: a line that is no document is left out and counted by ``rejected``, a field of an
unexpected shape is null. A field is asked for by path, so a document's other fields cost nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _get(document: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(document, path, kind)


def number(document: Column, path: str, kind: str = "bigint") -> Column:
    """A whole number stored as an int, a long, a text of digits, or wrapped as $numberLong or $numberInt.

    A fraction is none: stored documents hold 5.0 for 5 at times, so a number without a fractional part counts.
    """
    wrapped = [_get(document, f"{path}['{name}']", "string") for name in ("$numberLong", "$numberInt")]
    plain = _get(document, path, "decimal(38,9)")
    whole = F.when(plain == F.floor(plain), plain).try_cast("bigint")
    is_flag = F.schema_of_variant(_get(document, path, "variant")) == "BOOLEAN"
    text = F.coalesce(*wrapped, _get(document, path, "string"))
    digits = F.when(text.rlike(r"^[+-]?[0-9]{1,19}$"), text).try_cast("bigint")
    return F.when(~F.coalesce(is_flag, F.lit(False)), F.coalesce(whole, digits)).try_cast(kind)


def object_id(document: Column, path: str) -> Column:
    """An id wrapped as $oid, or as plain text."""
    return F.coalesce(_get(document, f"{path}['$oid']", "string"), _text(document, path))


def _text(document: Column, path: str) -> Column:
    """The value if it is text; numbers, flags, objects and lists are none."""
    value = _get(document, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", _get(document, path, "string"))


def flag(document: Column, path: str) -> Column:
    """A truth value, also stored as 0 and 1 or as text."""
    value = F.lower(_get(document, path, "string"))
    return F.when(value.isin("true", "1"), True).when(value.isin("false", "0"), False)


def location(document: Column, *paths: str) -> Column:
    """(latitude, longitude) of the first path that has both: an object of the two, or a point [longitude, latitude]."""
    found = []
    for path in paths:
        pairs = [(f"{path}.latitude", f"{path}.longitude"), (f"{path}.coordinates[1]", f"{path}.coordinates[0]")]
        for up, across in pairs:
            latitude, longitude = _get(document, up, "double"), _get(document, across, "double")
            both = latitude.between(-90, 90) & longitude.between(-180, 180)
            found.append(F.when(both, F.struct(latitude.alias("latitude"), longitude.alias("longitude"))))
    return F.coalesce(*found)


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines with a ``document``; null where a line is no JSON object."""
    document = F.try_parse_json(F.col(line))
    return lines.withColumn("document", F.when(F.schema_of_variant(document).startswith("OBJECT"), document))


def tweets_of(lines: DataFrame, line: str = "value") -> DataFrame:
    """Tweet rows of stored documents; those without an id or a text are left out."""
    d = F.col("document")
    rows = parsed(lines, line).select(
        object_id(d, "$._id").alias("_id"),
        number(d, "$.tweet_id").alias("tweet_id"),
        number(d, "$.createdAt").alias("createdAt"),
        location(d, "$.latitude", "$.location", "$.geoLocation").alias("latitude"),
        number(d, "$.user_id").alias("user_id"),
        _text(d, "$.user_name").alias("user_name"),
        number(d, "$.user_followers", "int").alias("user_followers"),
        _text(d, "$.tweetText").alias("tweetText"),
        _text(d, "$.lenguage").alias("lenguage"),
        flag(d, "$.contain_emoji").alias("contain_emoji"),
        object_id(d, "$.topic").alias("topic"),
    )
    return rows.where(F.col("tweet_id").isNotNull() & F.col("tweetText").isNotNull())


def rejected(lines: DataFrame, line: str = "value") -> DataFrame:
    """(reason, n) of the lines that give no row; one pass."""
    d = F.col("document")
    reason = (
        F.when(d.isNull(), "no document")
        .when(number(d, "$.tweet_id").isNull(), "no id")
        .when(_text(d, "$.tweetText").isNull(), "no text")
    )
    return parsed(lines, line).select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
