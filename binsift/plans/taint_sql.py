"""The forward walk in SQL: one recursive step for each operation of all functions, with the state in lists and maps.

Held against the operator on b_prog. State: T tainted, E external, M tainted memory, U products, K checked, N narrowed, R
freed (lists of names); C confidence, H hops, O origin, F field, L loaded from (maps by name); G freed fields; S steps; D
candidates; X number of unknown calls.
"""

from __future__ import annotations

# name, external arguments, argument written (-2 every pointer, -1 none), read from, result tainted, bounded, sizes, freed, sink type, tainted argument
_RULES = """
('recv', [1], 1, -1, true, true, [2], -1, '', -1), ('fread', [0], 0, -1, true, true, [1, 2], -1, '', -1), ('getenv', [], -1, -1, true, false, [], -1, '', -1),
('memcpy', [], 0, 1, false, true, [2], -1, 'buffer_overflow', 2), ('strcpy', [], 0, 1, false, false, [], -1, 'buffer_overflow', 1), ('malloc', [], -1, -1, false, false, [0], -1, 'integer_overflow', 0),
('free', [], -1, -1, false, false, [], 0, '', -1), ('system', [], -1, -1, false, false, [], -1, 'command_injection', 0), ('printf', [], -1, -1, false, false, [], -1, 'format_string', 0),
('fgets', [0], 0, -1, true, true, [1], -1, '', -1), ('calloc', [], -1, -1, false, false, [0, 1], -1, 'integer_overflow', -1), ('realloc', [], -1, -1, false, false, [1], -1, 'integer_overflow', 1),
('scanf', [], -2, -1, false, false, [], -1, '', -1), ('recvmsg', [1], 1, -1, true, false, [], -1, '', -1), ('png_free', [], -1, -1, false, false, [], 1, '', -1),
('png_safe_execute', [], -1, -1, false, false, [], -1, 'null_dereference', 1), ('strncpy', [], 0, 1, false, true, [2], -1, '', -1), ('snprintf', [], 0, -1, false, true, [1], -1, '', -1),
('xmlParserInputBufferPush', [2], 2, -1, false, false, [], -1, '', -1), ('bcopy', [], 1, 0, false, true, [2], -1, 'buffer_overflow', 2), ('png_read_row', [], 1, -1, false, false, [], -1, '', -1),
('strlen', [], -1, -1, true, false, [], -1, '', -1)
"""
_SOURCE = "CASE callee WHEN 'recv' THEN 1.0e0 WHEN 'fread' THEN 1.0e0 WHEN 'recvmsg' THEN 1.0e0 WHEN 'fgets' THEN 1.0e0 WHEN 'scanf' THEN 1.0e0 WHEN 'getenv' THEN 0.65e0 WHEN 'my_read_buffer' THEN 0.9e0 WHEN 'png_read_row' THEN 0.9e0 ELSE 0.0e0 END"
_ALLOCATES = "('malloc', 'calloc', 'realloc', 'xmalloc')"
_STATE = "fn, i, T, E, M, U, K, N, R, C, H, O, F, L, G, S, D, X"


def _has(where: str, name: str) -> str:
    return f"coalesce(list_contains({where}, {name}), false)"


def _put(where: str, when: str, name: str) -> str:
    return f"CASE WHEN {when} AND {name} IS NOT NULL AND NOT {_has(where, name)} THEN list_append({where}, {name}) ELSE {where} END AS {where}"


def _set(where: str, when: str, name: str, value: str) -> str:
    return f"CASE WHEN {when} AND {name} IS NOT NULL THEN map_concat({where}, MAP {{{name}: {value}}}) ELSE {where} END AS {where}"


def _step(when: str, source: str, to: str, reason: str, mem: str = "false") -> str:
    return f"CASE WHEN {when} AND {to} IS NOT NULL THEN list_append(S, {{'seq': i, 'op': op, 'a': {source}, 'b': {to}, 'r': {reason}, 'm': {mem}}}) ELSE S END AS S"


def _taint(when: str, name: str, reason: str, source: str = "NULL", outside: str = "false") -> str:
    """A stage that taints one name."""
    old = f"O[{name}]"
    return ", ".join(
        [
            _step(f"({when}) AND NOT {_has('T', name)}", source, name, reason),
            _set("O", f"({when}) AND ({old} IS NULL OR ({outside}) AND NOT starts_with({old}, 'external:'))", name, reason),
            _put("E", f"({when}) AND ({outside})", name),
            _set("H", f"({when}) AND H[{name}] IS NULL", name, "0"),
            _put("T", f"({when})", name),
        ]
    )


def _memory(when: str, name: str, reason: str, source: str = "NULL") -> str:
    return ", ".join([_step(f"({when}) AND NOT {_has('M', name)}", source, name, reason, "true"), _set("O", f"({when}) AND O[{name}] IS NULL", name, reason), _put("M", f"({when})", name)])


def _report(when: str, kind: str, sink: str, match: str, conf: str, source: str, var: str) -> str:
    return f"CASE WHEN {when} THEN list_append(D, {{'seq': i, 'kind': {kind}, 'sink': {sink}, 'm': {match}, 'c': round({conf}, 4), 's': {source}, 'v': {var}}}) ELSE D END AS D"


def _origin(name: str) -> str:
    return f"coalesce(O[{name}], {name})"


def _stages() -> list[str]:
    """SELECT lists, one over the other, that turn the state before an operation into the one after it."""
    any_ = lambda where, names="args": f"len(list_filter({names}, lambda z: list_contains({where}, z))) > 0"
    out: list[str] = []
    add = lambda *new: out.append("*, " + ", ".join(new))
    change = lambda *new: out.append(f"* REPLACE ({', '.join(new)})")
    seen = lambda x: f"({_has('T', x)} OR {_has('M', x)})"

    # Calls of library functions: what they sink, on the state before.
    add("op = 'CALL' AND rule IS NOT NULL AS lib", "list_concat([args[targ + 1], args[reads + 1]], args) AS order_", "list_filter(list_transform(sizes_, lambda z: args[z + 1]), lambda z: z IS NOT NULL) AS size_vars", f"coalesce(callee IN {_ALLOCATES}, false) AS allocates")
    add("list_filter(order_, lambda z: z IS NOT NULL AND (list_contains(T, z) OR list_contains(M, z)))[1] AS prime")
    add(f"prime IS NOT NULL AND {_has('E', 'prime')} AS p_ext", f"prime IS NOT NULL AND {_has('K', 'prime')} AS p_checked")
    add(
        f"""lib AND sink <> '' AND prime IS NOT NULL AND CASE WHEN sink = 'format_string' THEN p_ext
            WHEN sink = 'buffer_overflow' THEN p_ext AND NOT p_checked AND NOT (len(sizes_) > 0 AND len(list_filter(sizes_, lambda z: coalesce(starts_with(args[z + 1], 'const('), false))) = len(sizes_))
            WHEN sink = 'null_dereference' THEN {_has('T', 'args[2]')}
            WHEN sink = 'integer_overflow' AND allocates THEN len(size_vars) = 0 OR (({any_('T', 'size_vars')}) OR ({any_('M', 'size_vars')})) AND len(list_filter(size_vars, lambda z: NOT list_contains(K, z))) > 0
            WHEN sink = 'integer_overflow' THEN p_ext ELSE true END AS sinks""",
        "lib AND sink = '' AND NOT bounded AND p_ext AND NOT p_checked AND writes <> -1 AS copies",
    )
    change(_report("sinks", "sink", "callee", "CASE WHEN sink = 'integer_overflow' AND allocates THEN 'NO_MATCH' ELSE 'LIBRARY_MATCH' END", "0.95", _origin("prime"), "prime"))
    change(_report("copies", "'buffer_overflow'", "callee", "'LIBRARY_MATCH'", "0.95 * 0.9", _origin("prime"), "prime"))
    for j in (1, 2):
        v = f"size_vars[{j}]"
        bad = f"lib AND fn NOT IN {_ALLOCATES} AND {v} IS NOT NULL AND {_has('T', v)} AND {_has('E', v)} AND NOT {_has('K', v)} AND ({_has('U', v)} OR callee IN ('memcpy', 'bcopy'))"
        change(_report(bad, "'integer_overflow'", "callee", "CASE WHEN allocates THEN 'NO_MATCH' ELSE 'LIBRARY_MATCH' END", "0.95 * 0.9", _origin(v), v))
    # What they taint.
    change(_taint("lib AND len(ext) > 0", "args[ext[1] + 1]", "'external:' || callee", outside="true"))
    add("CASE WHEN NOT lib OR writes = -1 THEN [] WHEN writes = -2 THEN list_filter(args, lambda z, j: szs[j] = 8) ELSE list_filter([args[writes + 1]], lambda z: z IS NOT NULL) END AS written", "CASE WHEN lib AND reads >= 0 THEN args[reads + 1] END AS source")
    for j in (1, 2, 3):
        change(_memory(f"{_has('T', 'source')}", f"written[{j}]", "'write:' || callee", "source"))
    for j in (1, 2, 3):
        change(_memory("len(ext) > 0 OR writes = -2", f"written[{j}]", "'external:' || callee"))
    add("op IN ('CALL', 'CALLIND') AS calls", "NOT (op = 'CALL' AND rule IS NOT NULL) AND op IN ('CALL', 'CALLIND') AS unknown")
    # Every value made is a fresh one.
    change("CASE WHEN out_var IS NOT NULL AND op NOT IN ('STORE', 'CBRANCH', 'RETURN') THEN list_filter(R, lambda z: z <> out_var) ELSE R END AS R", "X + CASE WHEN unknown THEN 1 ELSE 0 END AS X")
    change(_taint("lib AND ret", "out_var", "'return:' || callee"))
    # Calls of which nothing is known.
    add(f"unknown AND ({any_('T')} OR {any_('M')}) AS passes")
    change(_taint("passes", "out_var", "'unknown_call:return'"))
    for j in (1, 2, 3):
        change(_memory(f"passes AND szs[{j}] = 8 AND {_has('T', f'args[{j}]')}", f"args[{j}]", "'unknown_call:ptr_arg'", f"args[{j}]"))
    add("list_filter(args, lambda z, j: szs[j] >= 4 AND list_contains(T, z) AND list_contains(E, z))[1] AS wide")
    change(_report("passes AND op = 'CALL' AND wide IS NOT NULL AND callee <> fn", "'unknown_call'", "callee", "'NO_MATCH'", "0.35", _origin("wide"), "wide"))
    # Freed pointers among the arguments, then the pointer that the call frees.
    add("CASE WHEN calls THEN list_filter(args, lambda z: list_contains(R, z))[1] END AS again", "CASE WHEN lib AND frees >= 0 THEN args[frees + 1] END AS gone")
    change(_report("again IS NOT NULL", "CASE WHEN lib AND frees >= 0 THEN 'double_free' ELSE 'use_after_free' END", "coalesce(callee, 'unknown')", "'NO_MATCH'", "CASE WHEN lib AND frees >= 0 THEN 0.8 ELSE 0.75 END", "again", "again"))
    change(_put("R", "gone IS NOT NULL", "gone"), "CASE WHEN gone IS NOT NULL AND L[gone] IS NOT NULL THEN list_append(G, L[gone]) ELSE G END AS G")
    change(_report("op = 'CALLIND' AND null_call", "'null_dereference'", "'CALLIND'", "'NO_MATCH'", "0.65", "'structural:callind_null_check'", "NULL"))
    # STORE
    add("CASE WHEN op = 'STORE' THEN CASE WHEN len(args) > 2 THEN args[2] ELSE args[1] END WHEN op = 'LOAD' THEN CASE WHEN len(args) > 1 THEN args[2] ELSE args[1] END END AS addr", "CASE WHEN op = 'STORE' THEN CASE WHEN len(args) > 2 THEN args[3] ELSE args[2] END END AS val")
    add("coalesce(val IN ('const(0x0)', 'const(0)'), false) AS nil")
    change(_memory(f"op = 'STORE' AND {_has('T', 'val')}", "addr", "'store:' || val", "val"))
    change(_report(f"op = 'STORE' AND {_has('T', 'addr')} AND {_has('E', 'addr')} AND F[addr] IS NULL", "'write_what_where'", "'STORE'", "'NO_MATCH'", "0.6", _origin("addr"), "addr"))
    add(f"addr IS NOT NULL AND F[addr] IS NOT NULL AND {_has('G', 'F[addr]')} AS stale", f"nil OR NOT {_has('T', 'val')} AS fresh")
    change(_report("op = 'STORE' AND stale AND NOT fresh", "'use_after_free'", "'STORE'", "'NO_MATCH'", "0.8", "addr", "addr"), "CASE WHEN op = 'STORE' AND stale AND fresh THEN list_filter(G, lambda z: z <> F[addr]) ELSE G END AS G")
    change(_report(f"op = 'STORE' AND {_has('R', 'addr')} AND NOT nil", "'use_after_free'", "'STORE'", "'NO_MATCH'", "0.75", "addr", "addr"))
    # LOAD
    add(f"op = 'LOAD' AND {seen('addr')} AS reads_")
    add(f"reads_ AND {_has('E', 'addr')} AS reads_ext")
    change(_taint("reads_", "out_var", "'load:*' || addr", "addr"))
    change(_put("E", "reads_ext", "out_var"), _set("L", "op = 'LOAD' AND F[addr] IS NOT NULL", "out_var", "F[addr]"))
    change(_report("op = 'LOAD' AND stale", "'use_after_free'", "'LOAD'", "'NO_MATCH'", "0.8", "addr", "addr"))
    change(_report(f"op = 'LOAD' AND {_has('R', 'addr')}", "'use_after_free'", "'LOAD'", "'NO_MATCH'", "0.75", "addr", "addr"))
    change(_report("op = 'LOAD' AND null_load", "'null_dereference'", "'LOAD'", "'NO_MATCH'", "0.7", "'structural:load_load_wrong_var_check'", "args[len(args)]"))
    # Values of values.
    add("list_filter(args, lambda z: list_contains(T, z)) AS ta", "op NOT IN ('CALL', 'CALLIND', 'STORE', 'LOAD', 'CBRANCH', 'RETURN') AS makes")
    add(
        "makes AND len(ta) > 0 AS live", "coalesce(list_filter(ta, lambda z: list_contains(E, z))[1], ta[1]) AS best", "len(list_filter(ta, lambda z: list_contains(E, z))) AS n_ext",
        "coalesce(list_max(list_transform(ta, lambda z: coalesce(C[z], 0e0))), 0e0) AS conf", "coalesce(list_max(list_transform(ta, lambda z: coalesce(H[z], 0))), 0) + 1 AS far",
    )
    add("live AND (conf > 0 OR CASE WHEN op IN ('INT_ADD', 'INT_AND', 'INT_RIGHT') THEN n_ext = len(ta) ELSE n_ext > 0 END) AS live_ext", f"{_origin('best')} AS root")
    change(
        _step(f"live AND NOT {_has('T', 'out_var')}", "best", "out_var", "'propagate:' || op"), _put("T", "live", "out_var"), _put("E", "live_ext", "out_var"), _set("O", "live", "out_var", "root"),
        _set("C", "live", "out_var", "greatest(conf, coalesce(C[out_var], 0e0))"), _set("H", "live", "out_var", "greatest(far, coalesce(H[out_var], 0))"),
    )
    change(_put("U", f"live AND (op = 'INT_MULT' OR op IN ('COPY', 'INT_ZEXT', 'INT_RIGHT', 'INT_ADD', 'INT_AND') AND {any_('U')})", "out_var"))
    change(_put("K", f"live AND (op = 'INT_MULT' AND len(list_filter(ta, lambda z: NOT list_contains(K, z))) = 0 OR op IN ('INT_ADD', 'COPY', 'INT_ZEXT') AND {any_('K')})", "out_var"))
    i2 = "args[2]"
    change(_report(f"live AND op = 'PTRADD' AND NOT starts_with({i2}, 'const(') AND {_has('T', i2)} AND {_has('E', i2)} AND {_has('U', i2)} AND NOT {_has('K', i2)}", "'integer_overflow'", "'PTRADD'", "'NO_MATCH'", "0.5", _origin(i2), i2))
    change(_set("F", f"live AND op = 'PTRSUB' AND starts_with({i2}, 'const(')", "out_var", f"args[1] || '+' || {i2}"))
    change(_report(f"live AND op = 'INT_AND' AND {i2} IN ('const(0xff)', 'const(0xffff)', 'const(0x3ff)') AND {_has('T', 'args[1]')} AND {_has('E', 'args[1]')} AND NOT {_has('K', 'args[1]')}", "'integer_truncation'", f"'INT_AND(mask=0x' || upper({i2}[9:-2]) || ')'", "'NO_MATCH'", "0.55", _origin("args[1]"), "args[1]"))
    need = f"CASE {i2} WHEN 'const(0xff)' THEN 8 WHEN 'const(0xffff)' THEN 4 WHEN 'const(0xffffffff)' THEN 8 END"
    change(_put("N", f"live AND (op = 'INT_AND' AND {need} IS NOT NULL AND {_has('T', 'args[1]')} AND szs[1] >= {need} OR op IN ('COPY', 'INT_ZEXT') AND {any_('N')})", "out_var"))
    # Comparisons.
    add("op IN ('INT_LESS', 'INT_EQUAL') AS compares", "coalesce(args[2] IN ('const(0xff)', 'const(0xffff)', 'const(0xffffffff)', 'const(0x3ff)', 'const(24)'), false) AS bound")
    for j in (1, 2):
        a = f"args[{j}]"
        change(_put("K", f"compares AND bound AND {_has('T', a)}", a))
        change(_report(f"compares AND {_has('T', a)} AND {_has('N', a)} AND {_has('E', a)}", "'integer_truncation'", "op", "'STRUCTURAL_MATCH'", "0.75", _origin(a), a))
    change(_step(f"op = 'CBRANCH' AND {_has('T', 'args[len(args)]')}", "args[len(args)]", "'branch_condition'", "'taint-controlled branch on ' || args[len(args)]"))
    return out


_BASE = f"""
rules(rule, ext, writes, reads, ret, bounded, sizes_, frees, sink, targ) AS (VALUES {_RULES.strip()}),
flat AS (SELECT fn, seq, op, out_var, callee, list_slice([in1, in2, in3], 1, n) AS args, list_slice([size1, size2, size3], 1, n) AS szs FROM b_prog)"""


def _probe(name: str, seeds: str) -> str:
    """CTEs that follow taint from seeds (fn, id, T): {name}(fn, id, T, M), the closure alone, one step an operation."""
    chain = f"SELECT s.* REPLACE (s.i + 1 AS i), f.op, f.out_var, f.callee, f.args, f.szs, r.* FROM {name}_w s JOIN flat f ON f.fn = s.fn AND f.seq = s.i + 1 LEFT JOIN rules r ON f.callee = r.rule"
    stages = [
        "*, op IN ('CALL', 'CALLIND') AND len(list_filter(args, lambda z: list_contains(T, z) OR list_contains(M, z))) > 0 AS touched, CASE WHEN op = 'STORE' THEN CASE WHEN len(args) > 2 THEN args[2] ELSE args[1] END WHEN op = 'LOAD' THEN CASE WHEN len(args) > 1 THEN args[2] ELSE args[1] END END AS addr, CASE WHEN op = 'STORE' THEN CASE WHEN len(args) > 2 THEN args[3] ELSE args[2] END END AS val",
        "*, touched AND (rule IS NULL OR ret) OR op = 'LOAD' AND (" + _has("T", "addr") + " OR " + _has("M", "addr") + ") OR op NOT IN ('CALL', 'CALLIND', 'STORE', 'LOAD', 'CBRANCH', 'RETURN') AND len(list_filter(args, lambda z: list_contains(T, z))) > 0 AS makes",
        "* REPLACE (" + _put("T", "makes", "out_var") + ")",
        "* REPLACE (" + _put("T", "touched AND rule IS NOT NULL AND len(ext) > 0", "args[ext[1] + 1]") + ")",
        "*, CASE WHEN touched AND rule IS NULL THEN list_filter(args, lambda z, j: szs[j] = 8 AND list_contains(T, z)) WHEN touched AND writes <> -1 AND (len(ext) > 0 OR writes = -2 OR reads >= 0 AND " + _has("T", "args[reads + 1]") + ") THEN CASE WHEN writes = -2 THEN list_filter(args, lambda z, j: szs[j] = 8) ELSE list_filter([args[writes + 1]], lambda z: z IS NOT NULL) END WHEN op = 'STORE' AND " + _has("T", "val") + " THEN [addr] ELSE [] END AS to_",
        "* REPLACE (list_distinct(list_concat(M, to_)) AS M)",
    ]
    for stage in stages:
        chain = f"SELECT {stage} FROM ({chain})"
    return f"""{name}_w AS (
  SELECT fn, id, CAST(-1 AS INTEGER) AS i, T, CAST([] AS VARCHAR[]) AS M FROM ({seeds})
  UNION ALL
  SELECT fn, id, i, T, M FROM ({chain})),
{name} AS (SELECT w.fn, w.id, w.T, w.M FROM {name}_w w JOIN (SELECT fn, max(seq) AS last_ FROM flat GROUP BY fn) z ON z.fn = w.fn AND z.last_ = w.i)"""


_SOURCES_OF = """
SELECT fn, 0 AS id, list(DISTINCT v) AS T FROM (
  SELECT f.fn, unnest(list_concat(CASE WHEN len(r.ext) > 0 THEN [f.args[r.ext[1] + 1]] ELSE [] END, CASE WHEN r.writes = -2 THEN list_filter(f.args, lambda z, j: f.szs[j] = 8) WHEN r.writes >= 0 THEN [f.args[r.writes + 1]] ELSE [] END, CASE WHEN r.ret AND f.out_var IS NOT NULL THEN [f.out_var] ELSE [] END)) AS v
  FROM flat f JOIN rules r ON r.rule = f.callee WHERE f.op = 'CALL' AND (len(r.ext) > 0 OR r.writes = -2)) t WHERE v IS NOT NULL GROUP BY fn"""
_ENTERED = f"""{_probe('reach', _SOURCES_OF)},
own AS (
  SELECT DISTINCT fn, -1 AS arg FROM reach
  UNION SELECT f.callee, j - 1 FROM flat f JOIN reach r ON r.fn = f.fn, unnest(range(1, len(f.args) + 1)) u(j) WHERE f.op = 'CALL' AND f.callee IS NOT NULL AND list_contains(r.T, f.args[j])),
up AS (SELECT fn, 0 AS far FROM own UNION SELECT c.fn, up.far + 1 FROM up JOIN (SELECT DISTINCT fn, callee FROM flat WHERE callee IS NOT NULL) c ON c.callee = up.fn WHERE up.far < 10),
entered AS (
  SELECT fn, CAST(arg AS INTEGER) AS arg FROM own
  UNION SELECT f.fn, CAST(j - 1 AS INTEGER) FROM flat f, unnest(range(1, len(f.args) + 1)) u(j) WHERE f.op = 'CALL' AND f.callee IN (SELECT fn FROM up) AND starts_with(f.args[j], 'VAR_'))"""
#: Parameters by position: variables used and never set, in order of first use.
_PARAMETERS = """
named AS (
  SELECT fn, var, row_number() OVER (PARTITION BY fn ORDER BY min(pos_)) - 1 AS position FROM (SELECT fn, unnest(args) AS var, seq * 10 + unnest(range(1, len(args) + 1)) AS pos_ FROM flat) u
  WHERE starts_with(var, 'VAR_') AND NOT EXISTS (SELECT 1 FROM flat f WHERE f.fn = u.fn AND f.out_var = u.var) GROUP BY fn, var)"""
_MOVES = "op IN ('COPY', 'CAST', 'INT_ZEXT', 'INT_SEXT', 'PTRADD', 'PTRSUB') AND out_var IS NOT NULL"
ENTERED = f"WITH RECURSIVE {_BASE},\n{_ENTERED}\nSELECT DISTINCT fn, arg FROM entered"
#: Effects of functions on their own, without those they call: aliases of parameters in order, first aliased input.
OWN_EFFECTS = f"""WITH RECURSIVE {_BASE},{_PARAMETERS},
{_probe('each', "SELECT fn, position AS id, [var] AS T FROM named")},
al AS (
  SELECT fn, CAST(-1 AS INTEGER) AS i, map_from_entries(list({{'k': var, 'v': position}})) AS A FROM named GROUP BY fn
  UNION ALL
  SELECT a.fn, a.i + 1, CASE WHEN {_MOVES} AND a.A[f.out_var] IS NULL AND len(list_filter(f.args, lambda z: a.A[z] IS NOT NULL)) > 0
    THEN map_concat(a.A, MAP {{f.out_var: a.A[list_filter(f.args, lambda z: a.A[z] IS NOT NULL)[1]]}}) ELSE a.A END FROM al a JOIN flat f ON f.fn = a.fn AND f.seq = a.i + 1),
alias AS (SELECT a.fn, a.A FROM al a JOIN (SELECT fn, max(seq) AS last_ FROM flat GROUP BY fn) z ON z.fn = a.fn AND z.last_ = a.i),
back AS (SELECT fn, arg_max(args[1], seq) AS var FROM flat WHERE op = 'RETURN' AND NOT starts_with(args[1], 'const(') GROUP BY fn)
SELECT DISTINCT e.fn, CAST(e.id AS INTEGER) AS arg, 'return' AS effect FROM each e JOIN back b ON b.fn = e.fn AND list_contains(e.T, b.var)
UNION SELECT e.fn, CAST(e.id AS INTEGER), 'mem:' || a.A[mem] FROM (SELECT *, unnest(M) AS mem FROM each) e JOIN alias a ON a.fn = e.fn WHERE a.A[mem] IS NOT NULL"""


def _sql(callers: bool = False) -> str:
    more = f",\n{_ENTERED},{_PARAMETERS}" if callers else ""
    third = "\n  UNION ALL SELECT DISTINCT n.fn, n.var, 3, n.position, 'external:interproc_arg_' || n.position, 0.8e0 FROM named n JOIN entered e ON e.fn = n.fn AND e.arg = n.position" if callers else ""
    chain = "SELECT s.*, o.op, o.out_var, o.callee, o.args, o.szs, o.null_call, o.null_load, r.* FROM w s JOIN o ON o.fn = s.fn AND o.seq = s.i + 1 LEFT JOIN rules r ON o.callee = r.rule"
    chain = chain.replace("s.*", "s.* REPLACE (s.i + 1 AS i)")
    for stage in _stages():
        chain = f"SELECT {stage} FROM ({chain})"
    null = "op IN ('INT_LESS_', 'INT_EQUAL') AND coalesce(list_contains(args, 'const(0x0)') OR list_contains(args, 'const(0)'), false)"
    return f"""
WITH RECURSIVE {_BASE}{more},
nulls AS (SELECT *, {null} AS nil_ FROM flat),
o AS (
  SELECT a.*, a.op = 'CALLIND' AND EXISTS (SELECT 1 FROM nulls b WHERE b.fn = a.fn AND b.nil_ AND b.seq BETWEEN a.seq + 1 AND a.seq + 12) AS null_call,
    a.op = 'LOAD' AND EXISTS (SELECT 1 FROM nulls b JOIN nulls c ON c.fn = b.fn AND c.nil_ AND c.seq BETWEEN b.seq + 1 AND b.seq + 3 AND list_contains(c.args, b.out_var)
      WHERE b.fn = a.fn AND b.seq = a.seq + 1 AND b.op = 'LOAD' AND b.args[len(b.args)] = a.out_var)
      AND NOT EXISTS (SELECT 1 FROM nulls d WHERE d.fn = a.fn AND d.nil_ AND d.seq < a.seq AND list_contains(d.args, a.out_var)) AS null_load
  FROM flat a),
uses AS (SELECT fn, seq, unnest(range(1, len(args) + 1)) AS slot, unnest(args) AS var, unnest(szs) AS size FROM flat),
params AS (
  SELECT fn, var, min(seq * 10 + slot)AS pos_ FROM uses u WHERE size IN (2, 4, 8) AND NOT starts_with(var, 'const(')
    AND NOT EXISTS (SELECT 1 FROM flat f WHERE f.fn = u.fn AND f.out_var = u.var) GROUP BY fn, var),
called AS (SELECT *, {_SOURCE} AS conf FROM flat WHERE op = 'CALL'),
seeded AS (
  SELECT fn, var, max(conf) AS conf, min(pos_) AS pos_ FROM (
    SELECT fn, out_var AS var, conf, seq * 10 AS pos_ FROM called WHERE conf > 0 AND out_var IS NOT NULL
    UNION ALL SELECT c.fn, u.var, conf, u.seq * 10 + u.slot FROM called c JOIN uses u ON u.fn = c.fn AND u.seq = c.seq WHERE conf > 0 AND u.size = 8 AND NOT starts_with(u.var, 'const(')) t GROUP BY fn, var),
first_ AS (
  SELECT fn, var, 1 AS pass, pos_, 'param:' || var AS reason, 0e0 AS conf FROM params
  UNION ALL SELECT s.fn, s.var, 2, s.pos_, 'external:3a_seed_' || s.var, s.conf FROM seeded s{third}),
once AS (SELECT *, row_number() OVER (PARTITION BY fn, var ORDER BY pass) AS nth, first_value(reason) OVER (PARTITION BY fn, var ORDER BY pass = 1, pass) AS root, max(conf) OVER (PARTITION BY fn, var) AS best FROM first_),
start AS (
  SELECT fn, list(var ORDER BY pass, pos_) AS T, list(var) FILTER (WHERE best > 0) AS E,
    map_from_entries(list({{'k': var, 'v': CAST(best AS DOUBLE)}})) AS C, map_from_entries(list({{'k': var, 'v': 0}})) AS H, map_from_entries(list({{'k': var, 'v': root}})) AS O,
    list({{'seq': -1, 'op': 'SEED', 'a': CAST(NULL AS VARCHAR), 'b': var, 'r': reason, 'm': false}} ORDER BY pass, pos_) AS S
  FROM once WHERE nth = 1 GROUP BY fn),
w AS (
  SELECT f.fn, CAST(-1 AS INTEGER) AS i, coalesce(T, []) AS T, coalesce(E, []) AS E, CAST([] AS VARCHAR[]) AS M, CAST([] AS VARCHAR[]) AS U, CAST([] AS VARCHAR[]) AS K, CAST([] AS VARCHAR[]) AS N, CAST([] AS VARCHAR[]) AS R,
    coalesce(C, MAP {{}}) AS C, coalesce(H, MAP {{}}) AS H, coalesce(O, MAP {{}}) AS O, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS F, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS L, CAST([] AS VARCHAR[]) AS G, coalesce(S, []) AS S,
    CAST([] AS STRUCT(seq INTEGER, kind VARCHAR, sink VARCHAR, m VARCHAR, c DOUBLE, s VARCHAR, v VARCHAR)[]) AS D, 0 AS X
  FROM (SELECT DISTINCT fn FROM flat) f LEFT JOIN start USING (fn)
  UNION ALL
  SELECT {_STATE} FROM ({chain})),
done AS (SELECT w.* FROM w JOIN (SELECT fn, max(seq) AS last_ FROM flat GROUP BY fn) z ON z.fn = w.fn AND z.last_ = w.i)
"""


WALK = _sql()
_CANDIDATES = """
SELECT fn, CAST(d.seq AS INTEGER) AS seq, d.kind AS vuln_type, d.sink AS sink_fn, d.m AS match_kind, d.c AS confidence, d.s AS taint_source, d.v AS taint_var FROM (
  SELECT *, row_number() OVER (PARTITION BY fn, d.sink, d.kind, d.s ORDER BY nth) AS k FROM (SELECT fn, unnest(D) AS d, unnest(range(len(D))) AS nth FROM done) t) t WHERE k = 1"""
CANDIDATES = WALK + _CANDIDATES
FROM_CALLERS = _sql(True) + _CANDIDATES
STEPS = f"""{WALK}
SELECT fn, CAST(nth AS INTEGER) AS step, CAST(s.seq AS INTEGER) AS seq, s.op AS op, s.a AS from_var, s.b AS to_var, s.r AS reason, s.m AS is_mem FROM (SELECT fn, unnest(S) AS s, unnest(range(len(S))) AS nth FROM done) t"""
TAINTED = f"""{WALK}
SELECT fn, v AS var, coalesce(O[v], v) AS source, list_contains(E, v) AS external, coalesce(C[v], 0e0) AS confidence, CAST(coalesce(H[v], 0) AS INTEGER) AS hops FROM (SELECT *, unnest(T) AS v FROM done) t"""
MARKS = f"""{WALK}
SELECT DISTINCT fn, mark, var FROM (
  SELECT fn, 'memory' AS mark, unnest(M) AS var FROM done UNION ALL SELECT fn, 'mult', unnest(U) FROM done UNION ALL SELECT fn, 'checked', unnest(K) FROM done
  UNION ALL SELECT fn, 'narrowed', unnest(N) FROM done UNION ALL SELECT fn, 'freed', unnest(R) FROM done) t"""
UNKNOWN = f"""{WALK}
SELECT fn, CAST(X AS INTEGER) AS unknown_calls FROM done"""
