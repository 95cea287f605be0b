"""Evidence about candidates: scores of functions, semantic risk, uncertainty, contradictions, role verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the eight scores of a function.
SCORE_WEIGHTS = {"exposure": 0.20, "validation": 0.20, "arithmetic": 0.20, "graph": 0.15, "semantic": 0.10, "pattern_store": 0.05, "memory": 0.05, "dangerous_calls": 0.05}


def _cap(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def _up_to(x: Column, most: float) -> Column:
    return F.least(x, F.lit(most))


def scores(f: DataFrame) -> DataFrame:
    """The eight scores and their weighted total from one row per function: counters of ops.features plus unchecked,
    reachable, dist, ppr, dangerous (reaches a dangerous call), role, role_conf, prototype, learned (role known from the
    store), call_points (summed call scores), sites (lower-cased callees joined), fan_out, sink_site, source_site,
    dangerous_callee."""
    c = {n: F.col(n) for n in f.columns}
    flag = lambda x, v: F.when(x, v).otherwise(0.0)
    n = F.greatest(c["instructions"], F.lit(1))
    hop = F.when(c["dist"] <= 1, 0.50).when(c["dist"] <= 2, 0.35).when(c["dist"] <= 3, 0.20).when(c["dist"] <= 4, 0.10).otherwise(0.0)
    by_role = F.when(c["role"].isin("parser", "decoder"), c["role_conf"] * 0.20).when(c["role"] == "dispatcher", c["role_conf"] * 0.10).otherwise(0.0)
    exposure = flag(c["reachable"], 0.35) + hop + flag(c["n_input_calls"] > 0, 0.20) + by_role
    tokens = F.lower(c["prototype"]).rlike("width|height|size|len|count|num")
    arithmetic = (
        _up_to(c["mults"] * 0.25, 0.50) + _up_to(c["shifts"] * 0.10, 0.20) + _up_to(c["pointers"] * 0.10, 0.20) + _up_to(c["casts"] * 0.08, 0.15) + _up_to(c["adds"] * 0.02, 0.15) + flag(c["unchecked"], 0.35) + flag(tokens, 0.10)
    )
    validation = _up_to(c["cbranches"] / n * 10.0, 0.35) + _up_to(c["compares"] * 0.08, 0.25) + F.when(c["role"] == "validator", c["role_conf"] * 0.35).otherwise(0.0) + flag((c["role"] == "parser") & (c["mults"] > 0), 0.15) + flag(c["unchecked"], 0.20)
    graph = (c["ppr"] * 0.60 + flag(c["reachable"], 0.20) + flag(c["dangerous"], 0.20)) * F.when(c["fan_out"] > 30, 0.5).otherwise(1.0)
    weight = F.when(c["role"].isin("parser", "validator", "decoder"), 0.50).when(c["role"].isin("state_machine", "dispatcher"), 0.35).when(c["role"].isin("unknown", "error_handler", "checksum", "math"), 0.0).otherwise(0.20)
    semantic = weight * c["role_conf"] * c["role_conf"] + flag(c["learned"], 0.40)
    memory = _up_to(c["loads"] / n * 3, 0.40) + _up_to(c["stores"] / n * 3, 0.40) + flag(c["heap_alloc"], 0.15) + flag(c["stack_alloc"], 0.10)
    dangerous = F.when(c["sink_site"], 0.70).when(c["source_site"], 0.50).otherwise(0.0) + flag(c["n_sink_calls"] > 0, 0.20) + flag(c["dangerous_callee"], 0.30)
    parts = {"exposure": exposure, "validation": validation, "arithmetic": arithmetic, "graph": graph, "semantic": semantic, "pattern_store": c["call_points"] / 20.0, "memory": memory, "dangerous_calls": dangerous}
    rows = f.select("fn", *[F.round(_cap(v), 6).alias(k) for k, v in parts.items()])
    total = F.lit(0.0)
    for k, w in SCORE_WEIGHTS.items():
        total = total + F.col(k) * w
    return rows.withColumn("total", F.round(F.round(total, 9), 4))


def reasons(scored: DataFrame) -> DataFrame:
    """fn and its scores as weighted parts, the largest first."""
    parts = F.array(*[F.struct((F.round(F.col(k) * w, 4)).alias("weight"), F.lit(k).alias("label")) for k, w in SCORE_WEIGHTS.items()])
    return scored.select("fn", F.sort_array(F.filter(parts, lambda p: p["weight"] > 0), asc=False).alias("reasons"))


def semantic_risk(counters: DataFrame) -> DataFrame:
    """Risk candidates of counters (mults, shifts, arith, stores, cbranches, allocs, arith_stores, role): fn, vuln_type,
    items. An integer overflow needs two observations; a buffer overflow two, and no integer overflow; a validator bypass two."""
    c = {n: F.col(n) for n in counters.columns}
    items = lambda *xs: F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in xs]))
    no_check, alloc = c["cbranches"] == 0, c["allocs"] > 0
    a = items(
        (c["role"].isin("parser", "decoder") | ((c["role"] == "unknown") & alloc), "role"),
        ((c["mults"] >= 1) | (c["shifts"] >= 1), "multiplication"),
        (c["arith"] >= 2, "arithmetic"),
        (alloc, "allocator_call"),
        (no_check & alloc, "no_bounds_check"),
        (c["arith_stores"] > 0, "unchecked_arith_store"),
    )
    b = items((c["role"].isin("decoder", "parser"), "role"), (c["stores"] >= 3, "high_store_count"), (c["arith"] >= 2, "arithmetic"), (no_check & (c["stores"] >= 3), "no_bounds_check"))
    v = items((c["role"] == "validator", "role"), ((c["role"] == "validator") & (c["cbranches"] < 2), "few_branches"), ((c["role"] == "validator") & (alloc | (c["stores"] >= 2)), "memory_writes"))
    rows = counters.select("fn", a.alias("a"), b.alias("b"), v.alias("v"))
    picks = F.array(
        F.when(F.size("a") >= 2, F.struct(F.lit("integer_overflow").alias("vuln_type"), F.col("a").alias("items"))),
        F.when((F.size("b") >= 2) & (F.size("a") < 2), F.struct(F.lit("buffer_overflow").alias("vuln_type"), F.col("b").alias("items"))),
        F.when(F.size("v") >= 2, F.struct(F.lit("validator_bypass").alias("vuln_type"), F.col("v").alias("items"))),
    )
    return rows.select("fn", F.explode(F.array_compact(picks)).alias("p")).select("fn", "p.vuln_type", "p.items")


def is_uncertain(unknown_source: Column, unknown_call: Column, missing_summary: Column) -> Column:
    """Whether two or more flags are set."""
    return unknown_source.cast("int") + unknown_call.cast("int") + missing_summary.cast("int") >= 2


def contradictions(forward: Column, n_items: Column, unknown_source: Column, backward: Column, checked: Column, mult: Column) -> Column:
    """Names of the contradictions in a candidate's evidence."""
    return F.array_compact(
        F.array(F.when(~forward & (n_items >= 2), F.lit("semantic_without_taint")), F.when(unknown_source & backward, F.lit("backward_source_only")), F.when(checked & mult, F.lit("check_beside_multiplication")))
    )


def needs_slice(path_confidences: Column) -> Column:
    """Whether no variable of a taint path has a source confidence, so that a backward slice is run."""
    return F.forall(path_confidences, lambda c: c == 0)


# Callees that bear a role out, words in a name that hint at it.
ROLE_CALLEES = {
    "allocator": "malloc calloc realloc new png_malloc png_calloc png_malloc_warn png_zalloc g_malloc g_malloc0 av_malloc av_mallocz zmalloc xmalloc smalloc safe_malloc safe_calloc xml_malloc",
    "read_input": "fread fgets fgetc fread_unlocked recv recvfrom recvmsg read pread getline getdelim scanf fscanf sscanf getenv xmlParserInputShrink png_crc_read psf_binheader_readf",
    "exec": "system execve execl execle execvp execlp popen wordexp posix_spawn ShellExecute shellexec sqlite3_exec",
    "free": "free delete png_free g_free av_free xmlFree xml_free sqlite3_free",
    "format_string": "printf fprintf sprintf snprintf vprintf vfprintf vsprintf vsnprintf syslog log_message",
}
ROLE_HINTS = {
    "allocator": "alloc malloc new create init",
    "read_input": "read recv input fetch get load parse",
    "validator": "check valid verify assert bound limit safe",
    "exec": "exec system shell spawn run",
    "free": "free release destroy dealloc delete",
}


def role_signs(ops: DataFrame) -> DataFrame:
    """What role verification looks at: fn and booleans of its operations and callees."""
    callee = F.lower("callee")
    calls = {r: F.coalesce(F.bool_or(callee.isin([x.lower() for x in names.split()])), F.lit(False)).alias(f"calls_{r}") for r, names in ROLE_CALLEES.items()}
    has = lambda *names: F.bool_or(F.col("op").isin(*names))
    compare = F.col("op").isin("INT_LESS", "INT_LESSEQUAL", "INT_EQUAL", "INT_NOTEQUAL", "INT_SLESS", "INT_SLESSEQUAL")
    constant = F.exists("args", lambda a: a.startswith("const"))
    return ops.groupBy("fn").agg(*calls.values(), has("LOAD").alias("loads"), has("STORE").alias("stores"), has("MULTIEQUAL").alias("loops"), has("CBRANCH").alias("branches"), F.bool_or(compare).alias("compares"), F.bool_or(compare & constant).alias("const_compares"))


def verify_role(role: Column, name: Column, pointers: Column, small: Column, returns_pointer: Column) -> Column:
    """struct(status, multiplier) of a role claimed for a function, over role_signs and its signature: numbers of 8-byte
    and 4-byte arguments, and whether it returns a pointer. Roles without a criterion are weakly confirmed with 0.8."""
    c = lambda n: F.col(n)
    hint = lambda r: F.exists(F.array(*[F.lit(w) for w in ROLE_HINTS[r].split()]), lambda w: F.contains(F.lower(name), w))
    points = lambda *xs: sum((F.when(cond, p).otherwise(0) for cond, p in xs), F.lit(0))
    verdict = lambda s, m: F.struct(F.lit(s).alias("status"), F.lit(float(m)).alias("multiplier"))
    sure, weak, none = verdict("confirmed", 1.0), verdict("weakly_confirmed", 0.6), verdict("refuted", 0.0)
    graded = lambda p: F.when(p >= 4, sure).when(p >= 2, weak).otherwise(none)
    alloc = points((c("calls_allocator"), 3), (returns_pointer, 1), (~c("stores"), 1), (hint("allocator"), 1))
    copy = points((c("loads") & c("stores"), 2), (pointers >= 2, 2), (small >= 1, 1), (c("loops"), 1))
    read = points((c("calls_read_input"), 4), (c("stores") & ~c("loads"), 2), (c("stores") & c("loads"), 1), (pointers >= 1, 1), (hint("read_input"), 1))
    check = points((c("compares"), 2), (c("branches"), 2), (c("const_compares"), 1), (hint("validator"), 1))
    less = verdict("weakly_confirmed", 0.7)
    return (
        F.when(role == "allocator", F.when(alloc >= 3, sure).when((alloc >= 2) & (c("calls_allocator") | hint("allocator")), weak).otherwise(none))
        .when(role == "copy", graded(copy))
        .when(role == "read_input", graded(read))
        .when(role == "validator", graded(check))
        .when(role == "exec", F.when(c("calls_exec"), sure).when(hint("exec"), less).otherwise(none))
        .when(role == "format_string", F.when(c("calls_format_string") & (pointers >= 2), sure).when(c("calls_format_string"), less).otherwise(none))
        .when(role == "free", F.when(c("calls_free"), sure).when(hint("free") & (pointers >= 1), less).otherwise(none))
        .otherwise(verdict("weakly_confirmed", 0.8))
    )


def rule_of_summary(role: Column, writes_at: Column, confidence: Column) -> Column:
    """Learned rule of a summary's role: struct(sink_type, return_tainted, vuln_score, writes_at, confidence); null for
    roles without effect on taint."""
    score = F.when(role.isin("allocator", "copy"), 2).when(role == "read_input", 3).when(role == "exec", 8).otherwise(0)
    sink = F.when(role == "allocator", "integer_overflow").when(role == "copy", "buffer_overflow").when(role == "exec", "command_injection").otherwise("")
    at = F.when(role == "copy", F.coalesce(writes_at, F.lit(0))).otherwise(F.coalesce(writes_at, F.lit(-1)))
    return F.when(~role.isin("other", "logger", "free"), F.struct(sink.alias("sink_type"), role.isin("allocator", "read_input").alias("return_tainted"), score.alias("vuln_score"), at.alias("writes_at"), F.coalesce(confidence, F.lit(0.6)).alias("confidence")))


# Library families told from names, in the order they are tried.
LIBRARIES = [
    ("png|libpng", "libpng (PNG image decoder)"),
    ("tiff|tif", "libtiff (TIFF image decoder)"),
    ("xml|html", "libxml2 (XML/HTML parser)"),
    ("sqlite|sql", "SQLite (embedded database)"),
    ("snd|sf_|psf_|audio|wav", "libsndfile (audio decoder)"),
]


def library_of(name: Column) -> Column:
    out = F.lit("unknown")
    for pattern, library in reversed(LIBRARIES):
        out = F.when(F.lower(name).rlike(pattern), library).otherwise(out)
    return out


def causal_chain(source: Column, path: Column, sink: Column, impact: Column) -> Column:
    """Source, the named steps of the path (once each, no variables, under 60 characters), sink, impact, as fn[role]."""
    steps = F.array_distinct(F.filter(F.transform(path, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("var") & (F.length(x) < 60) & (x != source) & (x != sink)))
    middle = F.transform(steps, lambda x: F.concat(x, F.lit("[propagates_taint]")))
    return F.array_join(F.concat(F.array(F.concat(source, F.lit("[external_input]"))), middle, F.array(F.concat(sink, F.lit("[sink]"))), F.array(F.concat(F.lit("IMPACT["), impact, F.lit("]")))), " -> ")


def append_uncovered(candidates: DataFrame, semantic: DataFrame) -> DataFrame:
    """Candidates with the semantic ones of two or more items whose type their function has none of."""
    more = semantic.filter(F.size("items") >= 2).join(candidates.select("fn", "vuln_type").distinct(), ["fn", "vuln_type"], "left_anti")
    return candidates.unionByName(more.drop("items"), allowMissingColumns=True)
