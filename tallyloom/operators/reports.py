"""Checks of reports against what they were made from, and evidence beside numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that no report may carry.
PRIVATE_KEYS = ["request", "response", "headers", "authorization", "cookie", "prompt", "text", "content", "api_key", "password"]


def united(df: DataFrame, key: list[str], fields: list[str], places: list[str], order: str) -> DataFrame:
    """Copies of one record as one: an unknown field yields to a known one, differing known ones are a conflict.

    Returns ``key``, copies, sources (the sorted ``order`` values of all
    copies), for each of ``fields`` its value and <field>_state (known,
    unknown, conflict), and ``places`` (all null where one of them differs)
    with ``issue``.
    """
    def agreed(c):
        return F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c))

    differs = F.lit(False)
    for c in places:
        differs = differs | ~F.min(c).eqNullSafe(F.max(c)) | (F.count(c).between(1, F.count("*") - 1))
    out = df.groupBy(*key).agg(
        F.count("*").alias("copies"), F.array_sort(F.collect_set(order)).alias("sources"), *[agreed(c).alias(c) for c in fields],
        *[F.when(F.count(c) == 0, "unknown").when(F.min(c) == F.max(c), "known").otherwise("conflict").alias(f"{c}_state") for c in fields],
        *[F.min(c).alias(c) for c in places], differs.alias("__differs"),
    )
    out = out.withColumns({c: F.when(~F.col("__differs"), F.col(c)) for c in places})
    return out.withColumn("issue", F.when(F.col("__differs"), "copies differ in time or turn")).drop("__differs")


def uncovered(required: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """What is required and not covered: key, once each."""
    return required.select(*key).distinct().join(covered.select(*key).distinct(), key, "left_anti")


def declared_and_actual(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key and state (both, not there, not declared) of what a list declares and what there is."""
    a = declared.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__d", F.lit(True))
    b = actual.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__a", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("__a").isNull(), "not there").when(F.col("__d").isNull(), "not declared").otherwise("both").alias("state"))


def attributed(entries: DataFrame, files: DataFrame) -> DataFrame:
    """The file that each entry means: entry, how (path, name, ambiguous, none), file.

    ``entries``: entry, path.  ``files``: file (a path).  An exact path counts
    before a file name that only one file has.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    exact = files.select(F.col("file").alias("f")).distinct()
    names = files.select("file").distinct().groupBy(name("file").alias("name")).agg(F.count("*").alias("n"), F.min("file").alias("only"))
    out = entries.join(exact, F.col("path") == F.col("f"), "left").withColumn("name", name("path")).join(names, "name", "left")
    how = F.when(F.col("f").isNotNull(), "path").when(F.col("n") == 1, "name").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return out.select("entry", how.alias("how"), F.when(how == "path", F.col("f")).when(how == "name", F.col("only")).alias("file"))


def bounded(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key, for a report, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def json_keys(df: DataFrame, key: str, column: str) -> DataFrame:
    """The keys, at any depth and in small letters, of JSON texts: key, name; broken JSON has none."""
    sound = df.where(F.try_parse_json(column).isNotNull())
    names = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)))
    return sound.select(key, F.explode(names).alias("name"))


def private_keys(df: DataFrame, key: str, column: str) -> DataFrame:
    """The forbidden keys of JSON texts: key, name."""
    return json_keys(df, key, column).where(F.col("name").isin(PRIVATE_KEYS))


def carried_scope(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds now_<column>: null keeps what was set before, the empty text clears it, anything else replaces it."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({f"now_{c}": F.nullif(F.last(c, ignorenulls=True).over(w), F.lit("")) for c in columns})


def cutoffs(df: DataFrame, key: str, at: str, eligible: Column) -> DataFrame:
    """Whether a key can serve as a cut-off: key, matches, state (usable, no eligible match, several matches, several times), at.

    Only one eligible match with one time is usable.
    """
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("matches"), F.count(F.when(eligible, 1)).alias("__e"), F.min(at).alias("__a"), F.max(at).alias("__b"))
    state = F.when(F.col("__e") == 0, "no eligible match").when(F.col("__a") != F.col("__b"), "several times").when(F.col("matches") > 1, "several matches").otherwise("usable")
    return out.select(key, "matches", state.alias("state"), F.when(state == "usable", F.col("__a")).alias("at"))


def envelope(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """From the earliest start to the latest end of each key: samples, total, missing, state, wall.

    ``total`` is the sum of the sound durations; a reversed sample makes a
    conflict, one without both ends makes the envelope unknown.
    """
    s, e = F.col(start), F.col(end)
    out = df.groupBy(*by).agg(
        F.count("*").alias("samples"), F.sum(F.when(e >= s, e - s)).alias("total"), F.count(F.when(s.isNull() | e.isNull(), 1)).alias("missing"), F.count(F.when(e < s, 1)).alias("__r"),
        F.min(s).alias("__a"), F.max(e).alias("__b"),
    )
    state = F.when(F.col("__r") > 0, "conflict").when(F.col("missing") > 0, "unknown").otherwise("known")
    return out.withColumn("state", state).withColumn("wall", F.when(F.col("state") == "known", F.col("__b") - F.col("__a"))).drop("__r", "__a", "__b")


def title_matches(expected: Column, actual: Column) -> Column:
    """Whether a title is another one, blanks aside, or that with a remark in full-width brackets behind it."""
    plain = lambda c: F.btrim(F.regexp_replace(c, r"\s+", " "))
    want, got = plain(expected), plain(actual)
    rest = F.btrim(F.substring(got, F.length(want) + 1, F.length(got)))
    noted = (want != "") & got.startswith(want) & rest.rlike("^（(?s:.+)）$")
    return F.coalesce((want == got) | noted, F.lit(False))
