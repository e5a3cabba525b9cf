"""Metric cells: a value together with how much is known of it.

A cell is a struct of value, state and reason.  States: ``reported``,
``derived``, ``unknown``, ``conflict``.  Null, unknown, conflict and zero are
four different things; nothing here turns one into another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["input", "output", "cache_read", "non_cache_read", "total"]

#: Why a cell has no plain value.
NOT_REPORTED = "not reported"
NOT_A_COUNT = "not a non-negative integer"
UNVERIFIED = "provider not verified"
CACHE_OVER_INPUT = "cache exceeds input"
TOTAL_DIFFERS = "total differs from input plus output"
SOURCES_DIFFER = "sources differ"
ZERO_UNSURE = "zero not confirmed"
#: Each reason is a bit of a mask while records are added up.
REASONS = [CACHE_OVER_INPUT, NOT_A_COUNT, NOT_REPORTED, UNVERIFIED, SOURCES_DIFFER, TOTAL_DIFFERS, ZERO_UNSURE]


def cell(value: Column | None, state: str | Column, reason: str | Column = "") -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct((value if value is not None else F.lit(None)).cast("long").alias("value"), as_col(state).alias("state"), as_col(reason).alias("reason"))


def known(c: Column) -> Column:
    return c["state"].isin("reported", "derived") & c["value"].isNotNull()


def count_cell(usage: Column, key: str, zero_uncertain: bool = False) -> Column:
    """The cell of a key of a JSON object (variant); texts, booleans, fractions and negatives are conflicts."""
    part = F.try_variant_get(usage, f"$.{key}", "variant")
    kind = F.schema_of_variant(part)
    value = F.try_variant_get(usage, f"$.{key}", "bigint")
    absent = part.isNull() | F.is_variant_null(part)
    whole = (kind == "BIGINT") & (value >= 0)
    out = F.when(absent, cell(None, "unknown", NOT_REPORTED)).when(~F.coalesce(whole, F.lit(False)), cell(None, "conflict", NOT_A_COUNT))
    if zero_uncertain:
        out = out.when(value == 0, cell(F.lit(0), "unknown", ZERO_UNSURE))
    return out.otherwise(cell(value, "reported"))


def usage_cells(df: DataFrame, usage_json: str, mapping: dict[str, str], total_key: str | None = None, verified: Column | None = None) -> DataFrame:
    """Adds a cell for each metric: those of ``mapping`` (metric to JSON key), non_cache_read and total.

    Broken or null JSON gives unknown cells.  Where ``verified`` is not true,
    all cells keep their value but are unknown.
    """
    u = "__usage"
    out = df.withColumn(u, F.try_parse_json(F.col(usage_json)))
    out = out.withColumns({m: count_cell(F.col(u), k) for m, k in mapping.items()})
    for m in ("input", "output", "cache_read"):
        if m not in mapping:
            out = out.withColumn(m, cell(None, "unknown", NOT_REPORTED))
    inp, outp, cache = F.col("input"), F.col("output"), F.col("cache_read")
    pair = known(inp) & known(cache)
    over = pair & (cache["value"] > inp["value"])
    both = known(inp) & known(outp)
    declared = F.try_variant_get(F.col(u), f"$.{total_key}", "bigint") if total_key else F.lit(None).cast("long")
    has_total = F.try_variant_get(F.col(u), f"$.{total_key}", "variant").isNotNull() if total_key else F.lit(False)
    total = inp["value"] + outp["value"]
    out = out.withColumns(
        {
            "non_cache_read": F.when(pair & ~over, cell(inp["value"] - cache["value"], "derived")).otherwise(cell(None, "unknown", NOT_REPORTED)),
            "cache_read": F.when(over, cell(None, "conflict", CACHE_OVER_INPUT)).otherwise(cache),
            "total": F.when(~both, cell(None, "unknown", NOT_REPORTED)).when(has_total & ~F.coalesce(declared == total, F.lit(False)), cell(None, "conflict", TOTAL_DIFFERS)).otherwise(cell(total, "derived")),
        }
    ).drop(u)
    if verified is not None:
        sure = F.coalesce(verified, F.lit(False))
        out = out.withColumns({m: F.when(sure, F.col(m)).otherwise(cell(F.col(m)["value"], "unknown", UNVERIFIED)) for m in METRICS})
    return out


def _bit(reason: Column) -> Column:
    """The bit of a reason, 0 for none."""
    out = F.when(reason == REASONS[0], 1)
    for i, r in enumerate(REASONS[1:], 1):
        out = out.when(reason == r, 1 << i)
    return out.otherwise(0)


def partials(metrics: list[str] = METRICS, calls: str | None = None) -> list[Column]:
    """The sums that an aggregate row is made of; they can be added up again by ``merged``."""
    out = [F.count("*").alias("records")]
    for m in metrics:
        c = F.col(m)
        out += [F.sum(F.when(known(c), c["value"])).alias(f"{m}_sum"), F.count(F.when(known(c), 1)).alias(f"{m}_known"), F.bit_or(_bit(c["reason"])).alias(f"{m}_why")]
    pair = known(F.col("input")) & known(F.col("cache_read"))
    out += [F.count(F.when(pair, 1)).alias("paired"), F.sum(F.when(pair, F.col("input")["value"])).alias("paired_input"), F.sum(F.when(pair, F.col("cache_read")["value"])).alias("paired_cache")]
    n = F.col(calls) if calls else F.lit(1)
    return [*out, F.sum(n).alias("calls_sum"), F.count(n).alias("calls_known")]


def merged(metrics: list[str] = METRICS) -> list[Column]:
    """Adds up rows of ``partials``."""
    out = [F.sum("records").alias("records")]
    for m in metrics:
        out += [F.sum(f"{m}_sum").alias(f"{m}_sum"), F.sum(f"{m}_known").alias(f"{m}_known"), F.bit_or(f"{m}_why").alias(f"{m}_why")]
    return [*out, *[F.sum(c).alias(c) for c in ("paired", "paired_input", "paired_cache", "calls_sum", "calls_known")]]


def finished(metrics: list[str] = METRICS) -> list[Column]:
    """The columns of an aggregate row: for each metric value, known records, state and sorted reasons, the paired cache ratio, the calls."""
    out = [F.col("records")]
    for m in metrics:
        k = F.col(f"{m}_known")
        out += [
            F.col(f"{m}_sum").alias(m), k.alias(f"{m}_known"), F.when(k == 0, "unknown").when(k == F.col("records"), "known").otherwise("partial").alias(f"{m}_state"),
            F.concat_ws("; ", *[F.when(F.col(f"{m}_why").bitwiseAND(1 << i) > 0, r) for i, r in sorted(enumerate(REASONS), key=lambda x: x[1])]).alias(f"{m}_reasons"),
        ]
    paired, whole = F.col("paired"), F.col("paired_input")
    ratio = F.when(whole > 0, F.col("paired_cache") / whole)
    state = F.when((paired > 0) & (whole == 0), "not_applicable").when(paired == 0, "unknown").when(paired == F.col("records"), "known").otherwise("partial")
    return [*out, ratio.alias("hit_rate"), state.alias("hit_rate_state"), F.when(F.col("calls_known") == F.col("records"), F.col("calls_sum")).alias("calls"), F.coalesce("calls_sum", F.lit(0)).alias("known_calls")]


def aggregate(df: DataFrame, by: list[str], metrics: list[str] = METRICS, calls: str | None = None) -> DataFrame:
    """Aggregate rows by ``by``: one shuffle, partial sums before it."""
    return df.groupBy(*by).agg(*partials(metrics, calls)).select(*by, *finished(metrics))


def dimension_views(df: DataFrame, dimensions: dict[str, list[str]], metrics: list[str] = METRICS) -> DataFrame:
    """Several views over one selection: dimension, identity and the aggregate columns.

    Records are added up once by all keys together; each view adds up those
    sums.  Null keys stand as empty text in the identity.
    """
    keys = list(dict.fromkeys(k for ks in dimensions.values() for k in ks))
    base = df.groupBy(*keys).agg(*partials(metrics))
    text = lambda ks: F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ks])
    views = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), text(ks).alias("identity")) for d, ks in dimensions.items()])).alias("v")
    spread = base.select(views, *[c for c in base.columns if c not in keys]).select("v.*", "*").drop("v")
    return spread.groupBy("dimension", "identity").agg(*merged(metrics)).select("dimension", "identity", *finished(metrics))


def reconcile(df: DataFrame, key: list[str], metrics: list[str], order: str) -> DataFrame:
    """One row per key: equal cells stay, differing cells become conflicts.

    ``order`` says which row's spelling of an equal value survives.  Adds
    ``copies``.
    """
    def one(m):
        c = F.col(m)
        spelt = F.xxhash64(F.coalesce(c["value"], F.lit(-1)), c["state"], c["reason"])
        same = F.min(spelt) == F.max(spelt)
        return F.when(same, F.min_by(c, F.col(order))).otherwise(cell(None, "conflict", SOURCES_DIFFER)).alias(m)

    return df.groupBy(*key).agg(F.count("*").alias("copies"), *[one(m) for m in metrics])
