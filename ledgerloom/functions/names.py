"""Names of classes, properties and units: vocabulary terms, identifiers that say nothing, words of labels, collisions."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def term(c: Column) -> Column:
    """A vocabulary's term without its address or prefix."""
    return F.regexp_replace(F.trim(c), r"^(?:https?://schema\.org/|schema:)", "")


def unit_name(c: Column) -> Column:
    """A unit's words in lower case, joined by underscores."""
    return F.array_join(F.filter(F.split(F.lower(c), r"[\s_]+"), lambda w: w != ""), "_")


def opaque(c: Column, prefix: str, salt: str) -> Column:
    """An identifier that is always the same for a name and says nothing about it: 40 bits of a salted hash."""

    @F.pandas_udf(T.StringType())
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else prefix + hashlib.blake2s(f"{salt}:{n}".encode(), digest_size=5).hexdigest())

    return run(c)


def refuse_collisions(names: DataFrame, name: str, identifier: str) -> DataFrame:
    """The table, if no identifier stands for two names; else an error that says which."""
    bad = names.groupBy(identifier).agg(F.count_distinct(name).alias("_n"), F.min(name).alias("_a"), F.max(name).alias("_b")).where("_n > 1").first()
    if bad:
        raise ValueError(f"{bad[identifier]} stands for {bad['_a']} and {bad['_b']}")
    return names


def words(c: Column) -> Column:
    """ASCII words of a label; letters lose their accents and stay."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(labels: pd.Series) -> pd.Series:
        def one(label):
            if label is None:
                return None
            plain = "".join(x for x in unicodedata.normalize("NFKD", label) if not unicodedata.combining(x))
            return re.findall("[A-Za-z0-9]+", plain)

        return labels.map(one)

    return run(c)


def class_stem(label: Column, identifier: Column) -> Column:
    """The label's words, each with a capital, as one; the identifier where the label has none."""
    made = F.array_join(F.transform(words(label), lambda w: F.concat(F.upper(w.substr(F.lit(1), F.lit(1))), w.substr(F.lit(2), F.length(w)))), "")
    return F.coalesce(F.nullif(made, F.lit("")), identifier)


def property_term(label: Column, identifier: Column, reserved: tuple[str, ...] = ()) -> Column:
    """The label's words in lower case with underscores; the identifier, in lower case, where that is no name of its own."""
    made = F.lower(F.array_join(words(label), "_"))
    return F.when((made == "") | made.isin(*reserved) | made.rlike("^[0-9]") | made.isNull(), F.lower(identifier)).otherwise(made)


def disambiguated(rows: DataFrame, name: str, identifier: str, to: str) -> DataFrame:
    """Add a name of its own for each row: of rows whose names are equal but for case, all bear their identifier."""
    same = F.count("*").over(W.partitionBy(F.lower(name)))
    return rows.withColumn(to, F.when(same > 1, F.concat_ws("_", name, identifier)).otherwise(F.col(name)))
