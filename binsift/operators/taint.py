"""Forward taint through a function's operations, in order, and what functions do to each other's arguments.

What is tainted, checked or freed at an operation depends on the ones before it, and frees are undone by fresh values, so
the walk is a state machine. It runs once per function on the function's own operations, which stream past it in order after
what is known of the functions it calls (`functionwise`); functions are dealt over the cluster. The part that is a mere closure has a relational form in `graph`.

Defined results: functions without operations have no row. Variables are told by name; a constant is only one where a call
or a store writes to its address. Candidates of equal sink, type and source are one, the first. Orders are by operation, then by argument.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import NOT_SOURCES, SOURCE_CONFIDENCE, SOURCE_FALLBACKS, SOURCE_ROLES, rule_rows
from . import functionwise
from .graph import Grown, levels, saved, strong_components

# Operations, functions, masks and confidences of the walk.
ALL_EXTERNAL = frozenset("INT_ADD INT_SUB INT_AND INT_OR INT_XOR INT_LEFT INT_RIGHT INT_SRIGHT".split())
CARRY_MULT = frozenset("COPY INT_ZEXT INT_SEXT INT_RIGHT INT_SRIGHT INT_LEFT INT_ADD INT_SUB INT_OR INT_AND".split())
CARRY_CHECK = frozenset("INT_MULT INT_ADD INT_SUB INT_LEFT COPY INT_ZEXT INT_SEXT".split())
CARRY_NARROW = frozenset("COPY INT_ZEXT INT_SEXT".split())
ALIAS = frozenset("COPY CAST INT_ZEXT INT_SEXT PTRADD PTRSUB".split())
COMPARE = frozenset("INT_LESS INT_LESSEQUAL INT_EQUAL INT_NOTEQUAL INT_SLESS INT_SLESSEQUAL".split())
CALLS = frozenset("CALL CALLIND".split())
NO_DATA = frozenset("BRANCH BRANCHIND RETURN INDIRECT".split())
ALLOCATORS = frozenset(
    "malloc calloc realloc reallocarray valloc pvalloc mmap mmap64 brk png_malloc png_malloc_warn png_calloc png_malloc_base png_realloc_array png_zalloc"
    " g_malloc g_malloc0 g_malloc_n g_realloc g_try_malloc xmalloc zmalloc smalloc emalloc HeapAlloc VirtualAlloc LocalAlloc GlobalAlloc".split()
) | {"operator new", "operator new[]"}
COPY_SINKS = frozenset("memcpy memmove memcpy_s bcopy png_memcpy".split())
FREES = {"free": 0, "png_free": 1, "g_free": 0, "cfree": 0, "png_free_data": 2}
WRITERS = "_write_ write_ _encode_ encode_ _serialize serialize_ _output_ output_ _emit_ emit_ _flush".split()
NARROW = frozenset((0xFF, 0xFFFF, 0xFFFFFF, 0x3FF, 0x7FF))
TRUNCATE = {0xFF: 8, 0xFFFF: 4, 0xFFFFFF: 4, 0xFFFFFFFF: 8}
UPPER_BOUND = 0x10
PARAMETER, SLICE_DEPTH = 0.55, 20
UAF_FIELD, FREED, DOUBLE_FREE, WRITE, UNKNOWN_CALL, OOB, NARROWED, TRUNCATED, CALLIND_NULL, LOAD_NULL = 0.80, 0.75, 0.80, 0.60, 0.35, 0.50, 0.55, 0.75, 0.65, 0.70
FROM_CALLER, COPIED = 0.80, 0.9
#: Operations of a function that is walked at most if the size filter of the stage before is wanted; None for no limit.
#: Registered queries and composed stages walk functions of any length (`whole`).
MOST_OPS: int | None = 8000
#: Parameters whose effects one pass over a function's operations finds.
BLOCK = 4096

CANDIDATES = "array<struct<seq:int,vuln_type:string,sink_fn:string,match_kind:string,confidence:double,taint_source:string,taint_var:string,taint_path:array<string>,bounded:boolean,hops:int,var_conf:double,path_conf:double,seed_fn:string,mult:boolean,checked:boolean,freed:boolean,backward_conf:double,backward_depth:int>>"
SCHEMA = (
    "fn string, tainted array<struct<var:string,source:string,external:boolean,confidence:double,hops:int>>, steps array<struct<step:int,seq:int,op:string,from_var:string,to_var:string,reason:string,is_mem:boolean>>,"
    f" candidates {CANDIDATES}, unknown_calls int, marks array<struct<mark:string,var:string>>"
)
EFFECTS = "fn string, arg int, effect string"


def const(name: str | None) -> int | None:
    """Value of const(..), hexadecimal after 0x, else decimal; null for variables."""
    if not name or not name.startswith("const("):
        return None
    digits = name[6:-1]
    try:
        return int(digits[2:], 16) if digits.startswith("0x") else int(digits)
    except ValueError:
        return None


def source_confidence(name: str) -> float:
    """How surely a called function brings external data: 0 if it doesn't."""
    if name in NOT_SOURCES:
        return 0.0
    for role, names in SOURCE_ROLES.items():
        if name in names.split():
            return SOURCE_CONFIDENCE[role]
    return next((SOURCE_CONFIDENCE[r] for word, r in SOURCE_FALLBACKS if word in name.lower()), 0.0)


@dataclass
class Rule:
    external: list[int]
    writes_at: int
    writes_all: bool
    reads_from: int
    returns: bool
    bounded: bool
    sizes: list[int]
    frees_at: int
    sink: bool
    sink_type: str
    taint_arg: int
    confidence: float

    @property
    def is_source(self) -> bool:
        return bool(self.external) or self.writes_all

    def written(self, args: list[str], sizes: list[int]) -> list[str]:
        """Arguments whose memory a call writes."""
        if self.writes_all:
            return [a for a, s in zip(args, sizes) if s == 8]
        return args[self.writes_at : self.writes_at + 1] if self.writes_at >= 0 else []


def catalog() -> dict[str, Rule]:
    return {r[0]: Rule(r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[10], r[11], r[12], r[13]) for r in rule_rows()}


def parameters(rows: Sequence[dict]) -> list[str]:
    """Variables that a function uses and never sets, in order of first use: its parameters by position."""
    made = {o["out"] for o in rows if o["out"]}
    return list(dict.fromkeys(a for o in rows for a in o["args"] if a and a.startswith(("VAR_", "Var")) and a not in made))


@dataclass(slots=True)
class Var:
    """What is known of one variable."""

    tainted: bool = False
    memory: bool = False  # what it points at is tainted
    external: bool = False
    confidence: float = 0.0
    hops: int | None = None
    origin: str | None = None
    path: tuple | None = None  # how taint came: (what came before, name), from the origin on
    mult: bool = False
    checked: bool = False
    narrowed: bool = False
    freed: bool = False
    field: tuple[str, int] | None = None  # the place in a structure that it points at
    loaded: tuple[str, int] | None = None  # the place that it was loaded from
    target: str | None = None  # the function whose address it holds


@dataclass
class Walk:
    """State of one function's walk and what it found.

    effects holds what called functions do, by name: (argument, effect) with the effects `return`, `mem:k`, `field:offset`
    (frees what stands there), `checks` and `external` (learned). targets holds function names by address.
    """

    fn: str
    rules: dict[str, Rule]
    effects: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    targets: dict[int, str] = field(default_factory=dict)
    silent: bool = False
    seeds: dict[str, tuple[float, str]] = field(default_factory=dict)  # confidence and source call of variables
    vars: dict[str, Var] = field(default_factory=dict)
    freed_fields: set[tuple[str, int]] = field(default_factory=set)
    steps: list[dict] = field(default_factory=list)
    found: dict[tuple, dict] = field(default_factory=dict)
    unknown_calls: int = 0
    muted: bool = False
    seq: int = -1
    op: str = "SEED"

    # -- state
    def of(self, name: str) -> Var:
        v = self.vars.get(name)
        if v is None:
            v = self.vars[name] = Var()
        return v

    def known(self, name: str | None) -> Var:
        """State of a name that may never have been met."""
        return self.vars.get(name) or Var()

    def seen(self, name: str | None) -> bool:
        """Whether a variable or what it points at is tainted."""
        v = self.known(name)
        return v.tainted or v.memory

    def origin(self, name: str) -> str:
        return self.known(name).origin or name

    def path(self, name: str) -> list[str]:
        """Origin of a variable's taint and the variables it came through."""
        out, at = [], self.known(name).path or (None, name)
        while at:
            out.append(at[1])
            at = at[0]
        return out[::-1]

    def step(self, origin: str | None, to: str, reason: str, is_mem: bool = False) -> None:
        self.steps.append({"step": len(self.steps), "seq": self.seq, "op": self.op, "from_var": origin or None, "to_var": to, "reason": reason, "is_mem": is_mem})

    def taint(self, name: str | None, reason: str, origin: str | None = None, confidence: float = 0.0) -> None:
        """Taint a variable. Its first origin stays unless that isn't external and the new one is."""
        if not name:
            return
        v = self.of(name)
        outside = reason.startswith("external:")
        if v.origin is None or outside and not v.origin.startswith("external:"):
            v.origin, v.path = reason, (None, reason)
        v.external |= outside or confidence > 0
        v.confidence = max(v.confidence, confidence)
        v.hops = v.hops or 0
        if not v.tainted:
            v.tainted = True
            self.step(origin, name, reason)

    def taint_memory(self, name: str | None, reason: str, origin: str | None = None) -> None:
        if not name:
            return
        v = self.of(name)
        if v.origin is None:
            v.origin, v.path = reason, (None, reason)
        if not v.memory:
            v.memory = True
            self.step(origin, name, reason, True)

    def report(self, kind: str, sink: str, match: str, conf: float, source: str, var: str | None, bounded: bool = False) -> None:
        if not self.muted and (sink, kind, source) not in self.found:
            path = self.path(var) if var else [source]
            self.found[sink, kind, source] = {"seq": self.seq, "vuln_type": kind, "sink_fn": sink, "match_kind": match, "confidence": round(conf, 4), "taint_source": source, "taint_var": var, "taint_path": path, "bounded": bounded}

    # -- operations
    def data(self, op: str, args: list[str], sizes: list[int], out: str | None) -> None:
        """Operations that make a value of values."""
        if not out:
            return
        self.of(out).freed = False
        if self._propagate(op, args, out):
            self._flags(op, args, sizes, out)
        if op in COMPARE:
            self._compare(op, args)
        if op == "PTRSUB" and len(args) > 1 and const(args[0]) == 0 and (to := self.targets.get(const(args[1]) or 0)):
            self.of(out).target = to
        if op in ("COPY", "CAST") and args and (to := self.known(args[0]).target):
            self.of(out).target = to

    def _propagate(self, op: str, args: list[str], out: str) -> bool:
        """Any tainted input taints the output, with the origin of the first external one, else of the first. Address and
        bit arithmetic is external only if all its tainted inputs are; a confidence makes any output external."""
        tainted = [a for a in args if self.known(a).tainted]
        if not tainted:
            return False
        best = next((a for a in tainted if self.vars[a].external), tainted[0])
        external = all(self.vars[a].external for a in tainted) if op in ALL_EXTERNAL else self.vars[best].external
        confidence = max(self.vars[a].confidence for a in tainted)
        hops = max(self.vars[a].hops or 0 for a in tainted) + 1
        before, v = self.vars[best], self.of(out)
        source, path = self.origin(best), (before.path or (None, best), out)
        if not v.tainted:
            self.step(best, out, f"propagate:{op}")
        v.tainted, v.origin, v.path, v.hops = True, source, path, max(v.hops or 0, hops)
        v.external |= external or confidence > 0
        v.confidence = max(v.confidence, confidence)
        return True

    def _flags(self, op: str, args: list[str], sizes: list[int], out: str) -> None:
        """What a tainted output keeps of its inputs, and what bad arithmetic shows."""
        v, ins = self.vars[out], [self.known(a) for a in args]
        v.mult |= op == "INT_MULT" or op in CARRY_MULT and any(x.mult for x in ins)
        if op in CARRY_CHECK:
            v.checked |= all(x.checked for x in ins if x.tainted) if op == "INT_MULT" else any(x.checked for x in ins)
        second = args[1] if len(args) > 1 else None
        if op == "PTRADD" and second and const(second) is None:
            i = self.known(second)
            if i.tainted and i.external and i.mult and not i.checked:
                self.report("integer_overflow", "PTRADD", "NO_MATCH", OOB, self.origin(second), second)
        if op == "PTRSUB" and const(second) is not None:
            v.field = args[0], const(second)
        if op == "INT_AND":
            i, mask = ins[0], const(second)
            if mask in NARROW and i.tainted and i.external and not i.checked:
                self.report("integer_truncation", f"INT_AND(mask=0x{mask:X})", "NO_MATCH", NARROWED, self.origin(args[0]), args[0])
            masks = [(a, const(a)) for a in args if const(a) in TRUNCATE]
            if masks:
                name, mask = masks[0]
                wide = next((s or 0 for a, s, x in zip(args, sizes, ins) if a != name and x.tainted), None)
                v.narrowed |= wide is not None and (wide == 0 or wide >= TRUNCATE[mask] and 8 * wide > mask.bit_length())
        v.narrowed |= op in CARRY_NARROW and any(x.narrowed for x in ins)

    def _compare(self, op: str, args: list[str]) -> None:
        bound = max((c for c in map(const, args) if c is not None), default=0) > UPPER_BOUND
        for a in args:
            x = self.known(a)
            if x.tainted:
                x.checked |= bound
                if x.narrowed and x.external:
                    self.report("integer_truncation", op, "STRUCTURAL_MATCH", TRUNCATED, self.origin(a), a)

    def store(self, args: list[str]) -> None:
        if len(args) < 2:
            return
        addr, value = args[1:3] if len(args) > 2 else args
        a, null = self.known(addr), const(value) == 0
        if self.known(value).tainted:
            self.taint_memory(addr, f"store:{value}", value)
            a = self.vars[addr]
        if a.tainted and a.external and a.field is None:
            self.report("write_what_where", "STORE", "NO_MATCH", WRITE, self.origin(addr), addr)
        if a.field in self.freed_fields:
            if null or not self.known(value).tainted:
                self.freed_fields.discard(a.field)
            else:
                self.report("use_after_free", "STORE", "NO_MATCH", UAF_FIELD, addr, addr)
        if a.freed and not null:
            self.report("use_after_free", "STORE", "NO_MATCH", FREED, addr, addr)

    def load(self, args: list[str], out: str | None) -> None:
        if not out or not args:
            return
        addr = args[1] if len(args) > 1 else args[0]
        self.of(out).freed = False
        if self.seen(addr):
            self.taint(out, f"load:*{addr}", addr)
            self.vars[out].external |= self.vars[addr].external
        a = self.known(addr)
        if a.field:
            self.of(out).loaded = a.field
            if a.field in self.freed_fields:
                self.report("use_after_free", "LOAD", "NO_MATCH", UAF_FIELD, addr, addr)
        if a.freed:
            self.report("use_after_free", "LOAD", "NO_MATCH", FREED, addr, addr)

    def branch(self, args: list[str]) -> None:
        if args and self.known(args[-1]).tainted:
            self.step(args[-1], "branch_condition", f"taint-controlled branch on {args[-1]}")

    def call(self, name: str, args: list[str], sizes: list[int], out: str | None, direct: bool) -> None:
        rule = self.rules.get(name)
        unknown = rule is None
        if rule:
            self._sinks(name, rule, args)
            self._writes(name, rule, args, sizes)
        if out:
            self.of(out).freed = False
        if rule and rule.returns:
            self.taint(out, f"return:{name}")
        if unknown:
            unknown = not self._summary(name if direct else self.known(name).target or name, args, out) and not self._specialised(args)
        for i, effect in self.effects.get(name, ()):  # learned, whether or not the function has a rule
            if i < len(args) and args[i]:
                if effect == "checks":
                    self.of(args[i]).checked = True
                elif effect == "external":
                    self.taint(args[i], f"external:llm_source:{name}")
        if unknown:
            self.unknown_calls += 1
            self._unknown(name, args, sizes, out, direct)
        self._frees(name, rule, args)

    def _sinks(self, name: str, r: Rule, args: list[str]) -> None:
        at = lambda i: args[i] if 0 <= i < len(args) else None
        primary = next((a for a in (at(r.taint_arg), at(r.reads_from), *args) if a and self.seen(a)), None)
        sizes = [at(i) for i in r.sizes if at(i) is not None]
        p = self.known(primary)
        allocates = name in ALLOCATORS
        if r.sink and primary:
            kind = r.sink_type or "buffer_overflow"
            if kind == "format_string":
                ok = p.external
            elif kind == "buffer_overflow":
                constant = bool(r.sizes) and all(const(at(i)) is not None for i in r.sizes)
                ok = p.external and not p.checked and not constant
            elif kind == "null_dereference":
                ok = self.known(at(1)).tainted
            elif kind == "integer_overflow" and allocates:
                ok = not sizes or any(map(self.seen, sizes)) and not all(self.known(s).checked for s in sizes)
            else:
                ok = kind != "integer_overflow" or p.external
            if ok:
                self.report(kind, name, "NO_MATCH" if kind == "integer_overflow" and allocates else "LIBRARY_MATCH", r.confidence, self.origin(primary), primary, r.bounded)
        elif not r.sink and not r.bounded and primary and p.external and not p.checked and (r.writes_all or r.writes_at >= 0):
            self.report("buffer_overflow", name, "LIBRARY_MATCH", r.confidence * COPIED, self.origin(primary), primary)
        if self.fn in ALLOCATORS:  # a wrapper's sizes are its callers'
            return
        for s in sizes:
            x = self.known(s)
            if x.tainted and x.external and not x.checked and (x.mult or name in COPY_SINKS):
                self.report("integer_overflow", name, "NO_MATCH" if allocates else "LIBRARY_MATCH", r.confidence * COPIED, self.origin(s), s)

    def _writes(self, name: str, r: Rule, args: list[str], sizes: list[int]) -> None:
        """What a call of a library function taints."""
        for i in r.external:
            if i < len(args):
                self.taint(args[i], f"external:{name}")
        written = r.written(args, sizes)
        source = args[r.reads_from] if 0 <= r.reads_from < len(args) else None
        for a in written:
            if self.known(source).tainted:
                self.taint_memory(a, f"write:{name}", source)
        if r.is_source:
            for a in written:
                self.taint_memory(a, f"external:{name}")
        if r.writes_all and r.external:
            for a in written:
                self.taint(a, f"external:{name}")

    def _summary(self, name: str, args: list[str], out: str | None) -> bool:
        """Apply what a function of the program is known to do; false if nothing is."""
        known = [x for x in self.effects.get(name, ()) if x[1] not in ("checks", "external")]
        for i, effect in known:
            if i < len(args) and self.known(args[i]).tainted:
                if effect == "return":
                    self.taint(out, f"interprocedural:{name}:return", args[i])
                elif effect.startswith("mem:") and int(effect[4:]) < len(args):
                    self.taint_memory(args[int(effect[4:])], f"interprocedural:{name}:mem", args[i])
        return bool(known)

    def _specialised(self, args: list[str]) -> bool:
        """Fields that a function frees whose address is passed: its parameters are the other arguments in order."""
        rest = [a for a in args if not self.known(a).target]
        hit = False
        for to in (self.known(a).target for a in args):
            for i, effect in self.effects.get(to, ()) if to else ():
                if effect.startswith("field:") and i < len(rest):
                    self.freed_fields.add((rest[i], int(effect[6:])))
                    hit = True
        return hit

    def _unknown(self, name: str, args: list[str], sizes: list[int], out: str | None, direct: bool) -> None:
        """A call of which nothing is known passes taint on, but doesn't bring any."""
        if not any(map(self.seen, args)):
            return
        self.taint(out, "unknown_call:return")
        for a, s in zip(args, sizes):
            if s == 8 and self.known(a).tainted:
                self.taint_memory(a, "unknown_call:ptr_arg", a)
        wide = [a for a, s in zip(args, sizes) if (s or 0) >= 4 and self.known(a).tainted and self.known(a).external]
        if direct and len(args) >= 2 and wide and name and name != self.fn:
            self.report("unknown_call", name, "NO_MATCH", UNKNOWN_CALL, self.origin(wide[0]), wide[0])

    def _frees(self, name: str, rule: Rule | None, args: list[str]) -> None:
        """Freed pointers among the arguments, then the pointer that the call itself frees."""
        frees = rule is not None and rule.frees_at >= 0
        hit = next((a for a in args if self.known(a).freed), None)
        if hit is not None:
            self.report("double_free" if frees else "use_after_free", name, "NO_MATCH", DOUBLE_FREE if frees else FREED, hit, hit)
        if frees and rule.frees_at < len(args):
            p = self.of(args[rule.frees_at])
            p.freed = True
            if p.loaded:
                self.freed_fields.add(p.loaded)


def _null_checks(rows: Sequence[dict]) -> tuple[set[int], set[int]]:
    """Places of indirect calls that a comparison with null follows within twelve operations, and of loads through a
    pointer that is loaded next and never compared, while what that gives is compared with null."""
    null = [o["op"] in ("INT_EQUAL", "INT_NOTEQUAL") and any(const(a) == 0 for a in o["args"]) for o in rows]
    calls = {k for k, o in enumerate(rows) if o["op"] == "CALLIND" and any(null[k + 1 : k + 13])}
    loads, compared = set(), set()
    for k, o in enumerate(rows):
        if null[k]:
            compared.update(a for a in o["args"] if a and a.startswith("VAR_"))
        nxt = rows[k + 1] if k + 1 < len(rows) else None
        if o["op"] == "LOAD" and o["out"] and o["out"] not in compared and nxt and nxt["op"] == "LOAD" and nxt["out"] and nxt["args"] and nxt["args"][-1] == o["out"]:
            if any(null[j] and nxt["out"] in rows[j]["args"] for j in range(k + 2, min(k + 5, len(rows)))):
                loads.add(k)
    return calls, loads


def walk(fn: str, rows: Sequence[dict], rules: dict[str, Rule], effects: dict | None = None, external_args: list[int] | None = None, reach: float = 1.0, targets: dict[int, str] | None = None) -> Walk:
    """Walk a function's operations: dicts of seq, op, callee, out, args, sizes, in order. external_args are positions of
    parameters that callers taint. Functions that only write and that no input reaches (reach 0) give no candidates but
    those of arithmetic."""
    w = Walk(fn, rules, effects or {}, targets or {}, reach == 0 and any(t in fn.lower() for t in WRITERS))
    made = {o["out"] for o in rows if o["out"]}
    for o in rows:
        for a, s in zip(o["args"], o["sizes"]):
            if a and a not in made and s in (2, 4, 8) and not a.startswith(("const(", "ram(")):
                w.taint(a, f"param:{a}")
    for o in rows:
        if o["op"] in CALLS and (c := source_confidence(o["callee"] or "")):
            wide = [a for a, s in zip(o["args"], o["sizes"]) if s == 8 and a and not a.startswith(("const(", "ram("))]
            for a in [o["out"], *wide] if o["out"] else wide:
                if c > w.seeds.get(a, (0.0, ""))[0]:
                    w.seeds[a] = c, o["callee"]
    for a, (c, _) in w.seeds.items():
        w.taint(a, f"external:3a_seed_{a}", None, c)
    params = parameters(rows)
    for i in sorted(external_args or []):
        if i < len(params):
            w.taint(params[i], f"external:interproc_arg_{i}", None, FROM_CALLER)
    null_calls, null_loads = _null_checks(rows)
    for k, o in enumerate(rows):
        op, args, sizes, out = o["op"], o["args"], o["sizes"], o["out"]
        w.seq, w.op = o["seq"], op
        w.muted = w.silent and (op in CALLS or op in ("STORE", "LOAD"))
        if op in CALLS:
            w.call((o["callee"] or "unknown").removeprefix("INDIRECT:"), args, sizes, out, op == "CALL")
            if k in null_calls:
                w.report("null_dereference", o["callee"] or "CALLIND", "NO_MATCH", CALLIND_NULL, "structural:callind_null_check", o["callee"])
        elif op == "STORE":
            w.store(args)
        elif op == "LOAD":
            w.load(args, out)
            if k in null_loads:
                w.report("null_dereference", "LOAD", "NO_MATCH", LOAD_NULL, "structural:load_load_wrong_var_check", args[-1])
        elif op == "CBRANCH":
            w.branch(args)
        elif op not in NO_DATA:
            w.data(op, args, sizes, out)
    _evidence(w, rows)
    return w


def definitions(rows: Sequence[dict]) -> dict[str, int]:
    """Place of the last operation that sets a variable."""
    return {o["out"]: k for k, o in enumerate(rows) if o["out"]}


def backward(rows: Sequence[dict], var: str, depth: int = SLICE_DEPTH, made: dict[str, int] | None = None) -> tuple[float, int]:
    """Confidence of the surest source that a variable comes from (PARAMETER for one that nothing sets), and the number of
    operations on the way back: breadth first over the last definitions, source calls end a branch."""
    made = definitions(rows) if made is None else made
    conf, n, seen, queue = 0.0, 0, {var}, deque([(var, 0)])
    while queue:
        name, far = queue.popleft()
        k = made.get(name)
        if k is None:
            conf = max(conf, PARAMETER)
        elif far < depth:
            o, n = rows[k], n + 1
            c = source_confidence(o["callee"] or "") if o["op"] in CALLS else 0.0
            conf = max(conf, c)
            for a in o["args"] if c == 0 else ():
                if a and a not in seen and not a.startswith(("const(", "ram(")):
                    seen.add(a)
                    queue.append((a, far + 1))
    return conf, n


def _evidence(w: Walk, rows: Sequence[dict]) -> None:
    """What the walk knows at its end of each candidate's variable and path; a backward slice where no variable of the path
    has a source confidence."""
    sliced: dict[str, tuple[float, int]] = {}
    made: dict[str, int] | None = None
    for c in w.found.values():
        var, path = c["taint_var"], c["taint_path"]
        v = w.known(var)
        path_conf = max((w.known(p).confidence for p in path), default=0.0)
        seed = w.seeds.get(var) or max((w.seeds[p] for p in path if p in w.seeds), key=lambda x: x[0], default=None)
        back = (None, None)
        if var and v.confidence == 0 and path_conf == 0:
            made = definitions(rows) if made is None else made
            back = sliced[var] = sliced.get(var) or backward(rows, var, made=made)
        c.update(hops=v.hops or 0, var_conf=v.confidence, path_conf=path_conf, seed_fn=seed and seed[1], mult=v.mult, checked=v.checked, freed=v.freed, backward_conf=back[0], backward_depth=back[1])


# -- what functions do with their parameters ---------------------------------------------------------------------------


def spread(rows: Sequence[dict], seeds: dict[str, int], rules: dict[str, Rule], effects: dict[str, list[tuple[int, str]]]) -> tuple[dict[str, int], dict[str, int]]:
    """Bits of the seeds that taint variables and memory: the closure alone, without sinks, checks and frees. A seed spreads
    as if it were alone, so one pass follows as many as there are bits."""
    live, memory = dict(seeds), {}

    def add(to: dict[str, int], name: str | None, bits: int) -> None:
        if bits:
            to[name] = to.get(name, 0) | bits

    def met(names: list[str]) -> int:
        bits = 0
        for a in names:
            bits |= live.get(a, 0)
        return bits

    for o in rows:
        op, args, sizes, out = o["op"], o["args"], o["sizes"], o["out"]
        if op in CALLS:
            bits = met(args)
            for a in args if memory else ():
                bits |= memory.get(a, 0)
            if not bits:
                continue
            name = (o["callee"] or "").removeprefix("INDIRECT:")
            rule, known = rules.get(name), effects.get(name)
            if rule:
                if rule.returns and out:
                    add(live, out, bits)
                for i in rule.external:
                    if i < len(args):
                        add(live, args[i], bits)
                bits = bits if rule.is_source else live.get(args[rule.reads_from], 0) if 0 <= rule.reads_from < len(args) else 0
                for a in rule.written(args, sizes) if bits else ():
                    add(memory, a, bits)
            elif known:
                for i, effect in known:
                    if i < len(args) and (bits := live.get(args[i], 0)):
                        if effect == "return" and out:
                            add(live, out, bits)
                        if effect.startswith("mem:") and int(effect[4:]) < len(args):
                            add(memory, args[int(effect[4:])], bits)
            else:
                if out:
                    add(live, out, bits)
                for a, s in zip(args, sizes):
                    if s == 8:
                        add(memory, a, live.get(a, 0))
        elif op == "STORE":
            addr, value = (args[1:3] if len(args) > 2 else args) if len(args) > 1 else (None, None)
            add(memory, addr, live.get(value, 0))
        elif op == "LOAD":
            addr = args[1] if len(args) > 1 else args[0] if args else None
            if out:
                add(live, out, live.get(addr, 0) | memory.get(addr, 0))
        elif op not in NO_DATA and op != "CBRANCH" and out:
            add(live, out, met(args))
    return live, memory


def freed_fields(rows: Sequence[dict], alias: dict[str, int], effects: dict[str, list[tuple[int, str]]], targets: dict[int, str]) -> set[tuple[int, int]]:
    """(parameter, offset) of the fields whose pointers a function frees, itself or through a function it knows the
    address of."""
    place: dict[str, tuple[str, int]] = {}
    loaded: dict[str, tuple[str, int]] = {}
    held: dict[str, str] = {}
    out: set[tuple[int, int]] = set()
    for o in rows:
        op, args, to = o["op"], o["args"], o["out"]
        if op == "PTRSUB" and to and len(args) > 1 and (offset := const(args[1])) is not None:
            place[to] = args[0], offset
            if const(args[0]) == 0 and offset in targets:
                held[to] = targets[offset]
        elif op in ("COPY", "CAST") and to and args and args[0] in held:
            held[to] = held[args[0]]
        elif op == "LOAD" and to and args and (at := args[1] if len(args) > 1 else args[0]) in place:
            loaded[to] = place[at]
        elif op in CALLS:
            name = (o["callee"] or "").removeprefix("INDIRECT:")
            name = name if op == "CALL" else held.get(name, "")
            if name in FREES:
                base, offset = loaded.get(args[FREES[name]], (None, 0)) if FREES[name] < len(args) else (None, 0)
                if base in alias:
                    out.add((alias[base], offset))
            for i, effect in effects.get(name, ()):
                if effect.startswith("field:") and i < len(args):
                    p = alias.get(args[i], alias.get(loaded.get(args[i], ("", 0))[0]))
                    if p is not None:
                        out.add((p, int(effect[6:])))
    return out


#: Stands for effects that aren't told one by one: a function with it is known, and it passes nothing on.
INSIDE = "inside"


def _places(bits: int) -> list[int]:
    """Numbers of the bits that are set."""
    return [k for k, bit in enumerate(reversed(f"{bits:b}")) if bit == "1"] if bits else []


def summary(rows: Sequence[dict], rules: dict[str, Rule], effects: dict[str, list[tuple[int, str]]], targets: dict[int, str] | None = None, widest: int | None = None) -> list[tuple[int, str]]:
    """What a function does with each of its parameters: (position, effect).

    With widest, the most arguments that any call passes, effects on and of parameters beyond it, which no call can meet,
    are told as one: INSIDE, if there are any."""
    params = parameters(rows)
    alias = {p: i for i, p in enumerate(params)}
    for o in rows:
        if o["op"] in ALIAS and o["out"] and o["out"] not in alias and (of := next((a for a in o["args"] if a in alias), None)):
            alias[o["out"]] = alias[of]
    returned = next((o["args"][0] for o in reversed(rows) if o["op"] == "RETURN" and o["args"] and o["args"][0] and const(o["args"][0]) is None), None)
    most = len(params) if widest is None else min(widest, len(params))
    found: set[tuple[int, str]] = {(i, f"field:{offset}") for i, offset in freed_fields(rows, alias, effects, targets or {})}
    # What is followed together: each parameter for itself, those beyond as one.
    groups = [[p] for p in params[:most]] + ([params[most:]] if most < len(params) else [])
    for lo in range(0, len(groups), BLOCK):
        live, memory = spread(rows, {p: 1 << k for k, group in enumerate(groups[lo : lo + BLOCK]) for p in group}, rules, effects)
        found.update((lo + k, "return") for k in _places(live.get(returned, 0)))
        into: dict[int, int] = {}  # parameters by what they write to, those beyond as one
        for v, bits in memory.items():
            if v in alias:
                to = min(alias[v], most)
                into[to] = into.get(to, 0) | bits
        for to, bits in into.items():
            effect = f"mem:{to}"
            found.update((lo + k, effect) for k in _places(bits))
    if widest is None:
        return sorted(found)
    kept = {(i, e) for i, e in found if i < widest and e != f"mem:{widest}"}
    return sorted(kept | {(0, INSIDE)} if len(kept) < len(found) else kept)


def passed_on(fn: str, rows: Sequence[dict], rules: dict[str, Rule], effects: dict[str, list[tuple[int, str]]]) -> list[tuple[str, int]]:
    """(callee, position) of the arguments that a function passes external data of its own calls in, and (fn, -1) if it
    calls anything that brings such data."""
    seeds: set[str] = set()
    for o in rows:
        rule = rules.get((o["callee"] or "").removeprefix("INDIRECT:")) if o["op"] in CALLS else None
        if rule and rule.is_source:
            seeds.update(o["args"][i] for i in rule.external if i < len(o["args"]))
            seeds.update(rule.written(o["args"], o["sizes"]))
            if rule.returns and o["out"]:
                seeds.add(o["out"])
    if not seeds:
        return []
    live, _ = spread(rows, dict.fromkeys(seeds, 1), rules, effects)
    marks = {(o["callee"].removeprefix("INDIRECT:"), i) for o in rows if o["op"] in CALLS and o["callee"] for i, a in enumerate(o["args"]) if a in live}
    return [(fn, -1), *sorted(marks)]


# -- on tables ---------------------------------------------------------------------------------------------------------


def calls(ops: DataFrame) -> DataFrame:
    """fn and callee of every call, once."""
    return ops.filter(F.col("op").isin(*CALLS) & F.col("callee").isNotNull()).select("fn", F.regexp_replace("callee", "^INDIRECT:", "").alias("callee")).distinct()


def pointers(ops: DataFrame, entries: DataFrame) -> DataFrame:
    """fn, address, callee: functions whose address a function takes. entries (fn, entry_addr) in hexadecimal."""
    hexed = F.lower(F.regexp_extract(F.get("args", 1), r"^const\(0x0*([0-9a-fA-F]+)\)$", 1))
    taken = ops.filter((F.col("op") == "PTRSUB") & F.get("args", 0).isin("const(0x0)", "const(0)")).select("fn", hexed.alias("at")).filter("at != ''").distinct()
    known = entries.select(F.col("fn").alias("callee"), F.regexp_replace(F.lower("entry_addr"), "^(0x)?0*(?=.)", "").alias("at"))
    return taken.join(known, "at").select("fn", F.conv("at", 16, 10).cast("long").alias("address"), "callee")


def analyze(ops: DataFrame, effects: DataFrame | None = None, external: DataFrame | None = None, entries: DataFrame | None = None, reach: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Walk every function of flat operations: fn, tainted, steps, candidates, unknown_calls, marks.

    effects (EFFECTS) says what functions do with their parameters: from `summaries`, from learned rules, or both. external
    (fn, arg) names parameters that callers taint, entries (fn, entry_addr) where functions start, reach (fn, reach) how
    surely input reaches them. Unless whole, functions of more than MOST_OPS operations are left out.
    """
    taken = None if entries is None else pointers(ops, entries)
    facts = known_facts(calls(ops), effects, taken)
    if external is not None:
        facts.append(functionwise.variables_of(external))
    if reach is not None:
        facts.append(functionwise.reach_of(reach))

    def make() -> functionwise.Job:
        rules = catalog()

        def job(fn: str, rows: Sequence[dict], told: functionwise.Facts) -> list[dict]:
            w = walk(fn, rows, rules, told.effects, told.variables, 1.0 if told.reach is None else told.reach, told.targets)
            names = sorted(w.vars.items())
            return [
                {
                    "fn": fn,
                    "tainted": [{"var": n, "source": w.origin(n), "external": v.external, "confidence": v.confidence, "hops": v.hops or 0} for n, v in names if v.tainted],
                    "steps": w.steps,
                    "candidates": list(w.found.values()),
                    "unknown_calls": w.unknown_calls,
                    "marks": [{"mark": m, "var": n} for m in ("memory", "mult", "checked", "narrowed", "freed") for n, v in names if getattr(v, m)],
                }
            ]

        return job

    return functionwise.per_function(ops, make, SCHEMA, _arrow(), facts, None if whole else MOST_OPS)


def known_facts(edges: DataFrame, effects: DataFrame | None, taken: DataFrame | None) -> list[DataFrame]:
    """Facts on functions from the effects of those they call (edges: fn, callee) or take the address of."""
    facts = []
    if effects is not None:
        used = edges if taken is None else edges.unionByName(taken.select("fn", "callee")).distinct()
        facts.append(functionwise.effects_of(used, effects))
    if taken is not None:
        facts.append(functionwise.targets_of(taken))
    return facts


def _arrow() -> pa.Schema:
    s, i, f, t = pa.string(), pa.int32(), pa.float64(), pa.bool_()
    return pa.schema(
        [
            ("fn", s),
            ("tainted", pa.list_(pa.struct([("var", s), ("source", s), ("external", t), ("confidence", f), ("hops", i)]))),
            ("steps", pa.list_(pa.struct([("step", i), ("seq", i), ("op", s), ("from_var", s), ("to_var", s), ("reason", s), ("is_mem", t)]))),
            ("candidates", pa.list_(pa.struct([("seq", i), ("vuln_type", s), ("sink_fn", s), ("match_kind", s), ("confidence", f), ("taint_source", s), ("taint_var", s), ("taint_path", pa.list_(s)), ("bounded", t), ("hops", i), ("var_conf", f), ("path_conf", f), ("seed_fn", s), ("mult", t), ("checked", t), ("freed", t), ("backward_conf", f), ("backward_depth", i)]))),
            ("unknown_calls", i),
            ("marks", pa.list_(pa.struct([("mark", s), ("var", s)]))),
        ]
    )


#: What a candidate is; the rest of its columns is what is known of it.
CANDIDATE = ["fn", "seq", "vuln_type", "sink_fn", "match_kind", "confidence", "taint_source", "taint_var"]


def candidates(walked: DataFrame) -> DataFrame:
    """One row per candidate: CANDIDATE and its evidence."""
    return walked.select("fn", F.explode("candidates").alias("c")).select("fn", "c.*")


def flow_steps(walked: DataFrame) -> DataFrame:
    return walked.select("fn", F.explode("steps").alias("s")).select("fn", "s.*")


def tainted(walked: DataFrame) -> DataFrame:
    return walked.select("fn", F.explode("tainted").alias("t")).select("fn", "t.*")


def marks(walked: DataFrame) -> DataFrame:
    """What the walk knows of variables at its end: memory, mult, checked, narrowed, freed."""
    return walked.select("fn", F.explode("marks").alias("m")).select("fn", "m.*")


def placed(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """fn, comp, level, cyclic of functions: the strongly connected component that calls (fn, callee) put a function in,
    callees' components before callers', and whether it can call itself again."""
    inside = edges.join(functions.select(F.col("fn").alias("callee")), "callee", "left_semi").select(F.col("fn").alias("caller"), "callee")
    comp = saved(strong_components(inside))
    of = lambda end: comp.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    between = saved(inside.join(of("caller"), "caller").join(of("callee"), "callee"))
    level = levels(between.filter("caller_comp != callee_comp").select(F.col("caller_comp").alias("caller"), F.col("callee_comp").alias("callee")))
    cyclic = between.filter("caller_comp = callee_comp").select(F.col("caller_comp").alias("comp"), F.lit(True).alias("cyclic")).distinct()
    found = comp.join(level.select(F.col("node").alias("comp"), "level"), "comp", "left").join(cyclic, "comp", "left")
    # Functions that call none of the program and that none calls have no edge.
    rows = functions.select("fn").join(found.withColumnRenamed("node", "fn"), "fn", "left")
    return rows.select("fn", F.coalesce("comp", "fn").alias("comp"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def summaries(ops: DataFrame, entries: DataFrame | None = None, chained: bool = True, known: DataFrame | None = None, whole: bool = False, met: bool = False) -> DataFrame:
    """Effects of each function's parameters, callees before callers: EFFECTS.

    Operations are written by the level of their function's component (placed). A round is one distributed job that reads
    its level with the effects of the functions called, so neither operations nor effects pass through the driver. Members
    of a cycle start from calls among themselves that do nothing and are done again with what was found of each other until
    nothing is new: the least fixpoint, whatever the order. (Taken in some order, with calls of members not yet done as
    unknown ones, as an engine without components would, effects through recursion are lost or guessed.) Effects only grow
    from round to round, of which there are at most as many as a component has effects, and few in practice. Not chained,
    each function is taken alone. known (EFFECTS) are effects of functions that ops doesn't hold.
    Unless whole, functions of more than MOST_OPS operations are left out. If met, effects on parameters that no call has
    an argument for are told as one (INSIDE): the walk and the marks of callers are the same, but a function of n
    operations, whose parameters and what they write to may each be some n, has no longer some n * n effects.
    """
    ops = saved(ops)
    widest = (ops.filter(F.col("op").isin(*CALLS)).agg(F.max(F.size("args"))).first()[0] or 0) if met else None
    edges, taken = saved(calls(ops)), None if entries is None else saved(pointers(ops, entries))
    schema = pa.schema([("fn", pa.string()), ("arg", pa.int32()), ("effect", pa.string())])

    def make() -> functionwise.Job:
        rules = catalog()
        return lambda fn, rows, told: [{"fn": fn, "arg": i, "effect": e} for i, e in summary(rows, rules, told.effects, told.targets, widest)]

    def found(rows: DataFrame, effects: DataFrame) -> DataFrame:
        return saved(functionwise.per_function(rows, make, EFFECTS, schema, known_facts(edges, effects, taken), None if whole else MOST_OPS))

    start = ops.sparkSession.createDataFrame([], EFFECTS) if known is None else known
    if not chained:
        return found(ops, start)
    place = saved(placed(edges, ops.select("fn").distinct()))
    leveled = saved(ops.join(place, "fn"), by="level")
    here = place.filter("cyclic").select("fn", "comp")
    inner = saved(edges.join(here, "fn").join(here.select(F.col("fn").alias("callee"), "comp"), ["callee", "comp"]).select("callee").distinct())
    inside = inner.select(F.col("callee").alias("fn"), F.lit(0).alias("arg"), F.lit(INSIDE).alias("effect"))
    done = Grown(start)
    for k, cyclic in sorted((r.level, r.cyclic) for r in place.groupBy("level").agg(F.max("cyclic").alias("cyclic")).collect()):
        rows, below = leveled.filter(F.col("level") == k), done.all()
        done.add(found(rows.filter("NOT cyclic"), below))
        if cyclic:
            done.add(_fixpoint(rows.filter("cyclic"), below, inside.join(place.filter(F.col("level") == k), "fn", "left_semi"), found))
    return done.all()


def _fixpoint(rows: DataFrame, below: DataFrame, inside: DataFrame, found: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Effects of the members of cycles of a level, done again until none is new."""
    now, n = None, 0
    while True:
        so_far = below.unionByName(inside) if now is None else below.unionByName(inside).unionByName(now)
        now = found(rows, so_far)
        if (m := now.count()) == n:
            return now
        n = m


def external_arguments(ops: DataFrame, effects: DataFrame | None = None, rounds: int = 10, whole: bool = False) -> DataFrame:
    """fn and arg of the parameters that external data enters functions by; arg -1 marks functions that bring it in.

    First each function's own calls of sources: what they taint is followed through the function, and the arguments it
    passes it on in are marked at the callee. Then upwards, up to `rounds` calls: a function that calls one of those marked
    is marked at the positions of the variables it passes. Unless whole, nothing is followed through functions of more than
    MOST_OPS operations.
    """
    ops = saved(ops)
    return entered(ops, passed(ops, effects, whole).select("fn", "arg").distinct(), rounds)


#: What functions pass on: `by` marks parameter `arg` of `fn`.
PASSED = "by string, fn string, arg int"


def passed(ops: DataFrame, effects: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Arguments that each function passes external data of its own in (PASSED)."""

    def make() -> functionwise.Job:
        rules = catalog()
        return lambda fn, rows, told: [{"by": fn, "fn": f, "arg": i} for f, i in passed_on(fn, rows, rules, told.effects)]

    schema = pa.schema([("by", pa.string()), ("fn", pa.string()), ("arg", pa.int32())])
    return functionwise.per_function(ops, make, PASSED, schema, known_facts(calls(ops), effects, None), None if whole else MOST_OPS)


def entered(ops: DataFrame, own: DataFrame, rounds: int = 10) -> DataFrame:
    """own marks (fn, arg) and those of the functions above them."""
    edges, own = saved(calls(ops)), saved(own)
    reached = saved(own.select("fn").distinct())
    front = reached
    for _ in range(rounds):
        front = saved(edges.join(front.withColumnRenamed("fn", "callee"), "callee", "left_semi").select("fn").distinct().join(reached, "fn", "left_anti"))
        if front.limit(1).count() == 0:
            break
        reached = reached.unionByName(front)
    to_marked = ops.filter(F.col("op").isin(*CALLS)).withColumn("callee", F.regexp_replace("callee", "^INDIRECT:", "")).join(reached.withColumnRenamed("fn", "callee"), "callee", "left_semi")
    above = to_marked.select("fn", F.posexplode("args").alias("arg", "var")).filter(F.col("var").startswith("VAR_")).select("fn", "arg")
    return own.unionByName(above).distinct()
