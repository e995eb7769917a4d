"""Contacts, labels, memories: link resolution, ranking, sampling, natural order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of least order for each key, by a grouped minimum instead of a sort."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__b"))
    return best.select(key, *[F.col(f"__b.{c}").alias(c) for c in rest])


def link(people: DataFrame, hidden: DataFrame, links: DataFrame, contacts: DataFrame) -> DataFrame:
    """person, contact: hidden people dropped; a disabled link gives none; a manual link wins over the contact of the same name.

    people(person), hidden(person), links(person, contact, disabled), contacts(contact, name), one row per person, person, contact.
    """
    named = first_by(contacts.select(F.lower("name").alias("k"), F.col("contact").alias("auto")), "k", "auto")
    known = contacts.select(F.col("contact").alias("manual"), F.lit(True).alias("alive"))
    p = people.join(hidden, "person", "left_anti").join(links.withColumnRenamed("contact", "manual"), "person", "left")
    p = p.join(known, "manual", "left").join(named, F.lower("person") == F.col("k"), "left")
    manual = F.col("manual").isNotNull()
    contact = F.when(F.coalesce("disabled", F.lit(False)), None).when(manual, F.when(F.col("alive"), F.col("manual"))).otherwise(F.col("auto"))
    return p.select("person", contact.alias("contact"))


def natural_key(name: Column) -> Column:
    """A key whose plain order is natural: lower case, and each run of digits without its leading zeros behind its length in three digits."""
    padded = F.regexp_replace(F.lower(name), r"([0-9]+)", "\u0001$1\u0001")
    part = lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lpad(F.length(F.regexp_replace(p, "^0+(?=.)", "")).cast("string"), 3, "0"), F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(p)
    return F.array_join(F.transform(F.split(padded, "\u0001"), part), "")
