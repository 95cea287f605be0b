"""Column functions over names, addresses and constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import OP_GROUPS, group_of


def clean_name(name: Column, indirect: Column | None = None) -> Column:
    """Call target without @plt, angle brackets and ram(); CALLIND targets as INDIRECT:name; empty as unknown."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "@plt", ""), "[<>]", ""), r"^ram\((.*)\)$", "$1")
    known = F.when(F.coalesce(F.trim(bare), F.lit("")) == "", F.lit("unknown")).otherwise(F.trim(bare))
    return known if indirect is None else F.when(indirect, F.concat(F.lit("INDIRECT:"), known)).otherwise(known)


def callee_lower(name: Column) -> Column:
    """Lower-cased, without @plt and angle brackets (verifier's form)."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, "@plt", ""), "[<>]", ""))


def callee_before_at(name: Column, lower: bool = True) -> Column:
    """Without angle brackets, up to the first @ (fingerprint's form; the summary's keeps case)."""
    bare = F.split_part(F.regexp_replace(name, "[<>]", ""), F.lit("@"), F.lit(1))
    return F.lower(bare) if lower else bare


def last_scope(name: Column, lower: bool = True) -> Column:
    """Last part after ::, up to the first parenthesis (sink's form; the source's keeps case)."""
    part = F.trim(F.split_part(F.element_at(F.split(name, "::"), -1), F.lit("("), F.lit(1)))
    return F.lower(part) if lower else part


def address(addr: Column) -> Column:
    """Lower-cased, out of ram(), without leading zeros and x; 0 if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(addr), r"^ram\((.*)\)$", "$1"), "^[0x]+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def entry_address(addr: Column) -> Column:
    """Lower-cased without leading zeros (the call graph's form)."""
    bare = F.regexp_replace(F.lower(addr), "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def raw_address(name: Column) -> Column:
    """Whether a call target is an address or indirect, not a name."""
    return name.startswith("0x") | name.startswith("INDIRECT:")


def constant(name: Column, space: Column | None = None, strict: bool = False) -> Column:
    """Value of a constant as DECIMAL(20,0), which holds every unsigned 64-bit one; null for other operands.

    Lenient: the space says const, or the name begins with const; hexadecimal after 0x, else decimal. Strict: the space
    must say const, and all is hexadecimal.
    """
    text = F.regexp_extract(name, r"^const\((?:0x)?([0-9a-fA-F]+)\)$", 1)
    hexadecimal = F.conv(text, 16, 10).cast("decimal(20,0)")
    decimal = F.expr("try_cast(NULL AS decimal(20,0))") if strict else text.try_cast("decimal(20,0)")
    value = hexadecimal if strict else F.when(name.contains("0x"), hexadecimal).otherwise(decimal)
    is_const = F.lit(True) if space is None and not strict else (space == "const") if strict else (space == "const") | name.startswith("const")
    return F.when(is_const & (text != ""), value)


def op_group(op: Column) -> Column:
    """Group of an operation mnemonic."""
    groups = F.create_map(*[F.lit(x) for pair in sorted(group_of().items()) for x in pair])
    return F.coalesce(F.try_element_at(groups, op), F.lit("other"))


def op_route(op: Column) -> Column:
    """Which rule family of the taint walk an operation goes to."""
    moves = F.when(op.isin("CALL", "CALLIND"), "call").when(op == "STORE", "store").when(op == "LOAD", "load").when(op == "CBRANCH", "cbranch")
    return moves.when(op.isin("BRANCH", "BRANCHIND", "RETURN"), "branch").when(op.isin("MULTIEQUAL", "INDIRECT"), "skip").otherwise("arith")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether text contains one of the words: a literal array, not a join."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)


def first_contained(text: Column, pairs: list[tuple[str, object]], default: object) -> Column:
    """Value of the first pair whose word text contains."""
    out = F.lit(default)
    for word, value in reversed(pairs):
        out = F.when(text.contains(word), F.lit(value)).otherwise(out)
    return out


GROUPS = sorted(OP_GROUPS)
