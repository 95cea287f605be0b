"""Where taint comes from and where it goes: source roles, sink classes, seeds, sink verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import NOT_SOURCES, SINK_CLASSES, SOURCE_CONFIDENCE, SOURCE_FALLBACKS, SOURCE_ROLES
from ..functions.names import last_scope


def source_role(name: Column) -> Column:
    """Role of a called function as a source: null for those that never are, exact names in order, substrings, UNKNOWN."""
    bare = last_scope(name, lower=False)
    role = F.lit("UNKNOWN")
    for word, r in reversed(SOURCE_FALLBACKS):
        role = F.when(F.lower(bare).contains(word), r).otherwise(role)
    for r, exact in reversed(SOURCE_ROLES.items()):
        role = F.when(bare.isin(exact.split()), r).otherwise(role)
    return F.when(bare.isin(NOT_SOURCES), F.lit(None).cast("string")).otherwise(role)


def base_confidence(role: Column) -> Column:
    conf = F.lit(0.0)
    for r, c in SOURCE_CONFIDENCE.items():
        conf = F.when(role == r, c).otherwise(conf)
    return conf


def role_of_confidence(conf: Column, within: float = 0.06) -> Column:
    """First role whose confidence is nearer than `within`; UNKNOWN if none."""
    role = F.lit("UNKNOWN")
    for r, c in reversed(SOURCE_CONFIDENCE.items()):
        role = F.when(F.abs(conf - c) < within, r).otherwise(role)
    return role


def sink_class(name: Column) -> Column:
    """Class of a sink: the first whose names contain the sink's or are contained in it."""
    n = last_scope(name)
    out = F.lit("GENERIC")
    for c, members in reversed(SINK_CLASSES.items()):
        known = F.array(*[F.lit(m.lower()) for m in members])
        out = F.when(F.exists(known, lambda m: F.contains(n, m) | F.contains(m, n)), c).otherwise(out)
    return out


def verify_sink(sink: Column, conf: Column, via_mult: Column, checked: Column, freed: Column) -> Column:
    """struct(emit, conf, tag): whether evidence supports a candidate at this class of sink, and with what confidence."""

    def verdict(emit: bool, c: Column | float, tag: str) -> Column:
        return F.struct(F.lit(emit).alias("emit"), (c if isinstance(c, Column) else F.lit(float(c))).cast("double").alias("conf"), F.lit(tag).alias("tag"))

    least = lambda factor, cap: F.least(conf * factor, F.lit(cap))
    allocator = (
        F.when(checked, verdict(False, 0, "allocator_size_checked"))
        .when(~via_mult, verdict(False, 0, "allocator_no_mult_evidence"))
        .when(conf < 0.40, verdict(False, 0, "allocator_source_conf_too_low"))
        .otherwise(verdict(True, least(0.95, 0.90), "allocator_arithmetic_evidence"))
    )
    copy = F.when(conf < 0.50, verdict(False, 0, "copy_source_conf_too_low")).when(checked, verdict(True, conf * 0.45, "copy_with_bounds_check")).otherwise(verdict(True, least(0.90, 0.85), "copy_unbounded"))
    fmt = F.when(conf < 0.70, verdict(False, 0, "format_source_conf_too_low")).otherwise(verdict(True, least(0.85, 0.80), "format_external_string"))
    free = F.when(freed, verdict(True, 0.75, "double_free_evidence")).otherwise(verdict(False, 0, "free_no_lifetime_evidence"))
    generic = F.when(conf < 0.30, verdict(False, 0, "generic_source_conf_too_low")).otherwise(verdict(True, least(0.85, 0.80), "generic_taint_reach"))
    return F.when(sink == "ALLOCATOR", allocator).when(sink == "COPY", copy).when(sink == "FORMAT", fmt).when(sink == "FREE", free).otherwise(generic)


def seeds(ops: DataFrame) -> DataFrame:
    """Variables that source calls taint (their result and 8-byte arguments that aren't constants): fn, var, conf,
    callee; one row a variable, of the most trusted call, of equal ones the first."""
    calls = ops.filter("callee IS NOT NULL").withColumn("role", source_role(F.col("callee"))).filter("role IS NOT NULL AND role != 'UNKNOWN'").withColumn("conf", base_confidence(F.col("role")))
    args = F.transform(F.arrays_zip("args", "sizes"), lambda x, i: F.struct((i + 1).alias("slot"), x["args"].alias("var"), x["sizes"].alias("size")))
    wide = F.filter(args, lambda x: (x["size"] == 8) & ~x["var"].startswith("const"))
    result = F.array(F.struct(F.lit(0).alias("slot"), F.col("out_var").alias("var"), F.lit(8).alias("size")))
    rows = calls.select("fn", "seq", "conf", "callee", F.explode(F.concat(result, wide)).alias("v")).filter("v.var IS NOT NULL")
    best = rows.groupBy("fn", F.col("v.var").alias("var")).agg(F.max_by(F.struct("conf", "callee"), F.struct("conf", -F.col("seq"), -F.col("v.slot"))).alias("b"))
    return best.select("fn", "var", "b.conf", "b.callee")


def is_allocator(name: Column) -> Column:
    """Whether a function is of the class of allocators."""
    return sink_class(name) == "ALLOCATOR"


def confidence_of(name: Column) -> Column:
    """Source confidence of a called function; 0 for those that are no source."""
    return F.coalesce(base_confidence(source_role(name)), F.lit(0.0))
