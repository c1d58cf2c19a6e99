"""Rules by domain: of all listed domains that a host belongs to, the longest decides.

Rules are indexed by their reversed labels (``org.example.shop``), so that a domain stands
directly before everything below it. A host asks for each of its own parent domains by an
equi-join on that key; no host is compared with a rule of another domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_name(host: Column) -> Column:
    """A host name in lower case, without dots at its end."""
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def reversed_labels(name: Column) -> Column:
    return F.array_join(F.reverse(F.split(name, r"\.")), ".")


def parent_keys(name: Column) -> Column:
    """The keys of a host and of all its parent domains; an address literal has no parents, an empty name no key."""
    labels = F.reverse(F.split(name, r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, 1, n), "."))
    literal = name.rlike(r"^[0-9.]+$|:")
    return F.when(name == "", F.array().cast("array<string>")).when(literal, F.array(reversed_labels(name))).otherwise(parents)


def rule_index(rules: DataFrame, domain: str = "domain") -> DataFrame:
    """Rules as ``key, rule`` (all columns of the rule), one for each domain.

    Of several rules of a domain the greatest counts, by its columns in order. Rules without
    a domain are dropped.
    """
    keyed = rules.withColumn("_name", plain_name(F.col(domain))).where(F.coalesce(F.col("_name") != "", F.lit(False)))
    return keyed.groupBy(reversed_labels(F.col("_name")).alias("key")).agg(F.max(F.struct(*rules.columns)).alias("rule"))


def longest_rule(rows: DataFrame, rules: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """Add ``rule``, the rule of the longest domain that the row's host is or lies below (NULL = none).

    Each distinct host is looked up once, so a host that very many rows hold costs no more
    than another; the rows meet the answers by one join on the host.
    """
    named = rows.withColumn("_name", plain_name(F.col(host)))
    asked = named.select("_name").where("_name is not null").distinct().withColumn("key", F.explode(parent_keys(F.col("_name"))))
    longest = asked.join(rule_index(rules, domain), "key").groupBy("_name").agg(F.max_by("rule", F.length("key")).alias("rule"))
    return named.join(longest, "_name", "left").drop("_name")
