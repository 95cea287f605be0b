"""Operations of functions as relations: normalised rows, uses, definitions, windows, features, fingerprints.

The flat form has one row per operation: fn, seq, op, callee (calls), out_var, args (array of operand names), sizes
(array of their bytes). Everything else derives from it by functions of one grouping key, fn, so one shuffle serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.dims import SKIPPED_OPS, TAINT_SINKS, TAINT_SOURCES
from ..functions.names import GROUPS, callee_before_at, clean_name, contains_any, op_group

CALLS = ("CALL", "CALLIND")


def by_seq() -> WindowSpec:
    """Operations of a function in order."""
    return Window.partitionBy("fn").orderBy("seq")


def flat(functions: DataFrame, keep_phi: bool = False) -> DataFrame:
    """Flat operations of nested function records (plus space, out_size, spaces): bookkeeping operations dropped, then
    numbered anew in list order."""
    skip = [o for o in SKIPPED_OPS if not (keep_phi and o == "MULTIEQUAL")]
    rows = functions.select(F.col("name").alias("fn"), F.posexplode("ops").alias("pos", "o")).filter(~F.col("o.op").isin(skip))
    number = (F.row_number().over(Window.partitionBy("fn").orderBy("pos")) - 1).cast("int")
    is_call = F.col("o.op").isin(*CALLS)
    args = F.when(is_call, F.slice("o.inputs", 2, 1000)).otherwise(F.col("o.inputs"))
    return rows.select(
        "fn",
        number.alias("seq"),
        F.col("o.op").alias("op"),
        F.when(is_call, clean_name(F.get("o.inputs", 0)["name"], F.col("o.op") == "CALLIND")).alias("callee"),
        F.col("o.output.name").alias("out_var"),
        F.transform(args, lambda v: v["name"]).alias("args"),
        F.transform(args, lambda v: v["size"]).alias("sizes"),
        F.transform(args, lambda v: v["space"]).alias("spaces"),
        F.col("o.output.size").alias("out_size"),
    )


def of_bridge(b_ops: DataFrame) -> DataFrame:
    """Flat operations of the bridge view."""
    return b_ops.select("fn", "seq", "op", "callee", "out_var", F.array("in1", "in2").alias("args"), F.array("in_size", "in_size").alias("sizes"))


def of_programs(b_prog: DataFrame) -> DataFrame:
    """Flat operations of the view of programs, with one to three arguments."""
    args, sizes = F.slice(F.array("in1", "in2", "in3"), 1, F.col("n")), F.slice(F.array("size1", "size2", "size3"), 1, F.col("n"))
    return b_prog.select("fn", "seq", "op", "callee", "out_var", args.alias("args"), sizes.alias("sizes"))


def without_skipped(ops: DataFrame, skipped: list[str]) -> DataFrame:
    """Operations without those mnemonics, numbered anew from 0 in each function."""
    left = ops.filter(~F.col("op").isin(skipped))
    return left.withColumn("seq", (F.row_number().over(by_seq()) - 1).cast("int"))


def uses(ops: DataFrame) -> DataFrame:
    """One row per operand: fn, seq, op, slot, var, size."""
    return ops.select("fn", "seq", "op", F.posexplode(F.arrays_zip("args", "sizes")).alias("slot", "u")).select("fn", "seq", "op", "slot", F.col("u.args").alias("var"), F.col("u.sizes").alias("size"))


def defs(ops: DataFrame) -> DataFrame:
    return ops.filter("out_var IS NOT NULL").select("fn", "seq", "op", F.col("out_var").alias("var"))


def last_definition(ops: DataFrame) -> DataFrame:
    """Defining operation of each variable; the last one wins."""
    return defs(ops).groupBy("fn", "var").agg(F.max("seq").alias("def_seq"), F.max_by("op", "seq").alias("def_op"))


def def_use(ops: DataFrame) -> DataFrame:
    """Every use of a variable with the operation that defines it: fn, seq, op, var, def_seq, def_op."""
    return uses(ops).select("fn", "seq", "op", "var").distinct().join(last_definition(ops), ["fn", "var"])


def first_occurrences(ops: DataFrame) -> DataFrame:
    """Canonical number of each variable of a function: its rank by first occurrence, inputs before the output of an
    operation; constants have none."""
    seen = uses(ops).select("fn", "var", F.struct("seq", "slot").alias("at")).unionByName(defs(ops).select("fn", "var", F.struct("seq", F.lit(1 << 20).alias("slot")).alias("at")))
    first = seen.filter(~F.col("var").startswith("const")).groupBy("fn", "var").agg(F.min("at").alias("at"))
    return first.select("fn", "var", (F.row_number().over(Window.partitionBy("fn").orderBy("at", "var")) - 1).cast("int").alias("number"))


def canonical(ops: DataFrame) -> DataFrame:
    """One row per operand under its canonical name: VAR_n by first occurrence, constants in hexadecimal as const(0x..),
    others as they are: fn, seq, slot (-1 for the output), name."""
    from ..functions.names import constant

    operands = uses(ops).select("fn", "seq", "slot", "var").unionByName(defs(ops).select("fn", "seq", F.lit(-1).alias("slot"), "var"))
    named = operands.join(first_occurrences(ops), ["fn", "var"], "left")
    value = constant(F.col("var"))
    hexed = F.concat(F.lit("const(0x"), F.lower(F.conv(value.cast("string"), 10, 16)), F.lit(")"))
    return named.select("fn", "seq", "slot", F.when(F.col("number").isNotNull(), F.concat(F.lit("VAR_"), F.col("number").cast("string"))).otherwise(F.coalesce(hexed, "var")).alias("name"))


def parameters(ops: DataFrame, sizes: tuple[int, ...] = (), before_first_call: bool = False) -> DataFrame:
    """Variables that are used but never defined, in the order of their first use: fn, var, position.

    sizes restricts the operand's bytes. before_first_call keeps every 8-byte variable first used before the function's
    first call instead, defined or not.
    """
    used = uses(ops).filter("var LIKE 'VAR\\\\_%'")
    if sizes:
        used = used.filter(F.col("size").isin(list(sizes)))
    first = used.groupBy("fn", "var").agg(F.min(F.struct("seq", "slot")).alias("at"))
    if before_first_call:
        call = ops.filter(F.col("op").isin(*CALLS)).groupBy("fn").agg(F.min("seq").alias("call_seq"))
        first = first.join(call, "fn", "left").filter("call_seq IS NULL OR at.seq < call_seq")
    else:
        first = first.join(defs(ops).select("fn", "var").distinct(), ["fn", "var"], "left_anti")
    return first.select("fn", "var", (F.row_number().over(Window.partitionBy("fn").orderBy("at", "var")) - 1).cast("int").alias("position"))


def last_return(ops: DataFrame) -> DataFrame:
    """First operand of the last RETURN."""
    return ops.filter("op = 'RETURN'").groupBy("fn").agg(F.max("seq").alias("seq"), F.max_by(F.get("args", 0), "seq").alias("var"))


def late_null_checks(ops: DataFrame, ahead: int = 12) -> DataFrame:
    """Indirect calls, each with whether a comparison follows within so many operations."""
    frame = by_seq().rowsBetween(1, ahead)
    seen = ops.withColumn("checked_late", F.coalesce(F.bool_or(F.col("op").isin("INT_EQUAL", "INT_NOTEQUAL")).over(frame), F.lit(False)))
    return seen.filter("op = 'CALLIND'").select("fn", "seq", "checked_late")


def chained_loads(ops: DataFrame, ahead: int = 3) -> DataFrame:
    """A LOAD right after a LOAD whose result it reads, the first result not compared before, the second compared within
    the next operations: fn, seq, first_var, second_var."""
    nxt = ops.select("fn", "seq", "op", "out_var", "args", F.lead("op").over(by_seq()).alias("op2"), F.lead("out_var").over(by_seq()).alias("var2"), F.lead("args").over(by_seq()).alias("args2"))
    pairs = nxt.filter("op = 'LOAD' AND op2 = 'LOAD' AND array_contains(args2, out_var)").select("fn", "seq", F.col("out_var").alias("first_var"), F.col("var2").alias("second_var"))
    checks = uses(ops).filter("op IN ('INT_EQUAL', 'INT_NOTEQUAL')").select("fn", F.col("seq").alias("check_seq"), "var")
    early = checks.groupBy("fn", F.col("var").alias("first_var")).agg(F.min("check_seq").alias("early"))
    late = pairs.join(checks.withColumnRenamed("var", "second_var"), ["fn", "second_var"]).filter(f"check_seq BETWEEN seq + 2 AND seq + 1 + {ahead}").select("fn", "seq").distinct()
    return pairs.join(early, ["fn", "first_var"], "left").filter("early IS NULL OR early >= seq").drop("early").join(late, ["fn", "seq"]).select("fn", "seq", "first_var", "second_var")


def histogram(ops: DataFrame) -> DataFrame:
    return ops.groupBy("fn", "op").agg(F.count("*").alias("n"))


def _n(*names: str) -> Column:
    return F.count_if(F.col("op").isin(*names))


def features(ops: DataFrame) -> DataFrame:
    """Counters of each function in one pass."""
    call = F.lower("callee")
    return ops.groupBy("fn").agg(
        F.count("*").alias("instructions"),
        (_n("CBRANCH") + 1).alias("cyclomatic"),
        (_n("CBRANCH", "BRANCH") + 1).alias("blocks"),
        _n("LOAD").alias("loads"),
        _n("STORE").alias("stores"),
        _n("INT_MULT").alias("mults"),
        _n("INT_ADD", "INT_SUB").alias("adds"),
        _n("INT_LEFT", "INT_RIGHT", "INT_SRIGHT").alias("shifts"),
        _n("PTRADD", "PTRSUB").alias("pointers"),
        _n("INT_ZEXT", "INT_SEXT").alias("casts"),
        _n("CBRANCH").alias("cbranches"),
        _n("INT_LESS", "INT_LESSEQUAL", "INT_SLESS", "INT_SLESSEQUAL").alias("compares"),
        _n(*CALLS).alias("calls"),
        _n("CALLIND").alias("indirect_calls"),
        F.array_sort(F.collect_set(F.when(contains_any(call, [s.lower() for s in TAINT_SOURCES]), F.col("callee")))).alias("input_calls"),
        F.array_sort(F.collect_set(F.when(contains_any(call, [s.lower() for s in TAINT_SINKS]), F.col("callee")))).alias("sink_calls"),
        F.coalesce(F.bool_or(contains_any(call, ["alloc"])), F.lit(False)).alias("heap_alloc"),
    )


def unchecked_stores(ops: DataFrame) -> DataFrame:
    """Whether a function stores a result of ADD, SUB or MULT that no earlier CBRANCH looked at: fn, unchecked."""
    arith = ops.filter("op IN ('INT_ADD', 'INT_SUB', 'INT_MULT') AND out_var IS NOT NULL").groupBy("fn", F.col("out_var").alias("var")).agg(F.min("seq").alias("made"))
    checked = uses(ops).filter("op = 'CBRANCH'").groupBy("fn", "var").agg(F.min("seq").alias("checked"))
    stored = uses(ops).filter("op = 'STORE'").groupBy("fn", "var").agg(F.min("seq").alias("first"), F.max("seq").alias("stored"))
    hit = stored.join(arith, ["fn", "var"]).join(checked, ["fn", "var"], "left")
    # Some store after the definition and before the first check.
    open_ = uses(ops).filter("op = 'STORE'").select("fn", "var", F.col("seq").alias("at")).join(hit, ["fn", "var"]).filter("at > made AND (checked IS NULL OR checked > at)")
    flagged = open_.select("fn", F.lit(True).alias("unchecked")).distinct()
    return ops.select("fn").distinct().join(flagged, "fn", "left").select("fn", F.coalesce("unchecked", F.lit(False)).alias("unchecked"))


def risk_counters(ops: DataFrame) -> DataFrame:
    """Counters of the semantic-risk rules; arith_stores are STOREs right after an arithmetic operation."""
    before = F.lag("op").over(by_seq())
    alloc = contains_any(F.lower("callee"), ["alloc"])
    marked = ops.withColumn("after_arith", (F.col("op") == "STORE") & F.coalesce(before.isin("INT_ADD", "INT_SUB", "INT_MULT", "PTRADD", "PTRSUB"), F.lit(False))).withColumn("is_alloc", F.coalesce(alloc, F.lit(False)))
    return marked.groupBy("fn").agg(
        _n("INT_MULT").alias("mults"),
        _n("INT_LEFT").alias("shifts"),
        _n("CBRANCH").alias("cbranches"),
        _n("STORE").alias("stores"),
        F.count_if("after_arith").alias("arith_stores"),
        F.count_if("is_alloc").alias("allocs"),
        F.min_by(F.when(F.col("is_alloc"), F.col("callee")), F.when(F.col("is_alloc"), F.col("seq"))).alias("allocator"),
    )


def flags(ops: DataFrame, dangerous: list[str]) -> DataFrame:
    """The boolean flags of each function; has_loop means that it branches on a condition."""
    has = lambda *names: F.bool_or(F.col("op").isin(*names))
    rows = ops.groupBy("fn").agg(
        has("LOAD").alias("has_load"),
        has("STORE").alias("has_store"),
        has("CBRANCH").alias("has_loop"),
        has("CALLIND").alias("has_indirect_call"),
        has("INT_ADD", "INT_SUB", "INT_MULT", "INT_DIV").alias("has_int_arith"),
        has("PTRADD", "PTRSUB").alias("has_pointer_arith"),
        has(*CALLS).alias("has_call"),
        F.array_join(F.array_sort(F.collect_set(F.lower("callee"))), " ").alias("sites"),
    )
    found = rows.withColumn("calls_dangerous_import", contains_any(F.col("sites"), [d.lower() for d in dangerous]))
    return found.withColumn("has_mem_and_call", (F.col("has_load") | F.col("has_store")) & F.col("has_call")).drop("sites", "has_call")


def ordered_hash(ops: DataFrame, item: Column, name: str = "fingerprint") -> DataFrame:
    """16 hex digits of the hash of a function's items in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))), lambda x: x["item"]), " ")
    return ops.groupBy("fn").agg(F.substring(F.sha2(joined, 256), 1, 16).alias(name))


def call_signature(ops: DataFrame, known: list[str]) -> DataFrame:
    """Sorted distinct known callees of a function, empty if none."""
    name = callee_before_at(F.col("callee"))
    hit = F.when(F.col("op").isin(*CALLS) & name.isin([k.lower() for k in known]), name)
    return ops.groupBy("fn").agg(F.array_join(F.array_sort(F.collect_set(hit)), ",").alias("signature"))


def group_vector(ops: DataFrame) -> DataFrame:
    """20 numbers: shares of the 14 operation groups; loop, call, indirect call, branch density; loads and stores."""
    grouped = ops.withColumn("g", op_group(F.col("op")))
    n = F.count("*")
    of = lambda g: F.count_if(F.col("g") == g)
    flag = lambda c: F.when(c > 0, 1.0).otherwise(0.0)
    flow = [flag(_n("MULTIEQUAL")), flag(of("call")), flag(of("indirect_call")), F.least(F.lit(1.0), of("branch") / n * 10)]
    memory = [F.least(F.lit(1.0), of("mem_read") / n * 5), F.least(F.lit(1.0), of("mem_write") / n * 5)]
    return grouped.groupBy("fn").agg(F.array(*[F.round(x, 6) for x in (*[of(g) / n for g in GROUPS], *flow, *memory)]).alias("vector"))


def structural_key(ops: DataFrame, known: list[str]) -> DataFrame:
    """16 hex digits of the hash of a function's group counts and call signature (exact fingerprint)."""
    grouped = ops.withColumn("g", op_group(F.col("op"))).groupBy("fn").agg(*[F.count_if(F.col("g") == g).alias(f"n_{g}") for g in GROUPS])
    text = F.concat_ws("|", F.concat_ws(",", *[F.concat(F.lit(f"{g}:"), F.col(f"n_{g}").cast("string")) for g in GROUPS]), "signature", F.lit("ptrs=0"))
    return grouped.join(call_signature(ops, known), "fn").select("fn", F.substring(F.sha2(text, 256), 1, 16).alias("skey"))


def structural_role(ops: DataFrame, known: list[str]) -> DataFrame:
    """Role of a function from its known callees, else from its operation groups; first rule that holds."""
    grouped = ops.withColumn("g", op_group(F.col("op"))).groupBy("fn").agg(*[F.bool_or(F.col("g") == g).alias(g) for g in ("mem_write", "cmp", "branch")])
    sig = F.col("signature")
    role = (
        F.when(contains_any(sig, ["malloc", "calloc", "realloc"]), "allocator")
        .when(contains_any(sig, ["free"]), "free")
        .when(contains_any(sig, ["memcpy", "memmove"]), "copy")
        .when(contains_any(sig, ["fread", "recv", "read"]), "read_input")
        .when(F.col("cmp") & F.col("branch") & ~F.col("mem_write"), "validator")
        .otherwise("unknown")
    )
    return grouped.join(call_signature(ops, known), "fn").select("fn", role.alias("role"))


def counter_role(features: DataFrame) -> DataFrame:
    """Role and confidence told from counters alone: the first of five threshold rules."""
    f = {c: F.col(c) for c in features.columns}
    rules = [
        ((f["loads"] <= 2) & (f["stores"] <= 2) & (f["calls"] <= 3) & (f["mults"] == 0) & (f["cbranches"] <= 3), "error_handler", 0.40),
        ((f["cbranches"] >= 3) & (f["compares"] >= 2) & (f["stores"] * 20 < f["instructions"]), "validator", 0.55),
        ((f["cbranches"] >= 4) & (f["loads"] >= 5) & (f["calls"] >= 2), "parser", 0.50),
        ((f["mults"] + f["adds"] + f["shifts"] >= 10) & (f["loads"] <= 3) & (f["calls"] <= 2), "math", 0.45),
        (f["heap_alloc"] & (f["calls"] <= 4), "allocator", 0.60),
    ]
    role, conf = F.lit("unknown"), F.lit(0.0)
    for holds, name, c in reversed(rules):
        role, conf = F.when(holds, name).otherwise(role), F.when(holds, c).otherwise(conf)
    return features.select("fn", role.alias("role"), conf.alias("role_conf"))


def context(ops: DataFrame, centres: DataFrame, around: int = 10) -> DataFrame:
    """Operations within `around` of each centre (fn, at): fn, at, seq, op."""
    hit = centres.select("fn", "at").join(ops.select("fn", "seq", "op"), "fn")
    return hit.filter(F.abs(F.col("seq") - F.col("at")) <= around).select("fn", "at", "seq", "op")


def operand_space(op: Column, callee: Column, operand: Column) -> Column:
    """Space of a call's first operand: external where its target has a name, else by the operand."""
    named = op.isin(*CALLS) & callee.isNotNull() & ~callee.startswith("0x")
    return F.when(named, "external").when(operand.startswith("const"), "const").otherwise("unique")


def resolved_targets(calls: DataFrame, functions: DataFrame, symbols: DataFrame, address: str = "address") -> DataFrame:
    """calls with `target`: the function's name at the address, else the symbol's, else the address in hexadecimal.
    functions and symbols: address, name."""
    first, second = (t.select(F.col("address").alias(address), F.col("name").alias(n)) for t, n in ((functions, "_fn"), (symbols, "_sym")))
    return calls.join(first, address, "left").join(second, address, "left").withColumn("target", F.coalesce("_fn", "_sym", F.concat(F.lit("0x"), F.lower(F.hex(address))))).drop("_fn", "_sym")


def qualified(flat: DataFrame, binary: Column) -> DataFrame:
    """Flat operations of several programs as of one: functions, and callees that the same program defines, are named
    `program!function`, so that equal names of two programs stay apart in every operator."""
    named = flat.withColumn("_binary", binary)
    own = named.select("_binary", F.col("fn").alias("callee")).distinct().withColumn("_own", F.lit(True))
    rows = named.join(own, ["_binary", "callee"], "left")
    full = lambda c: F.concat_ws("!", F.col("_binary"), F.col(c))
    return rows.withColumn("callee", F.when(F.col("_own"), full("callee")).otherwise(F.col("callee"))).withColumn("fn", full("fn")).select(*flat.columns)
