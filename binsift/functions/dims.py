"""Dimension tables of the engine, as plain values and as DataFrames.

Rules are data: a rule added to a table changes what the operators find, no code does.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession

# The library rules, as rows of named fields. Arguments are numbered from 0; writes_at is the argument whose
# memory is written, `pointers` for every pointer; fields that don't apply are empty.
RULES_CSV = """
name,external_input,writes_at,reads_from,return_tainted,bounded,size_args,frees_at,return_is_buffer,sink_type,taint_arg,vuln_score
fread,0,0,,yes,yes,1 2,,,,,4
read,1,1,,yes,yes,2,,,,,4
recv,1,1,,yes,yes,2,,,,,5
recvfrom,1,1,,yes,yes,2,,,,,5
recvmsg,1,1,,yes,,,,,,,5
fgets,0,0,,yes,yes,1,,,,,3
gets,0,0,,yes,,,,,buffer_overflow,0,9
scanf,,pointers,,,,,,,,,4
fscanf,,pointers,,,,,,,,,4
sscanf,,pointers,,,,,,,,,3
getenv,,,,yes,,,,,,,3
ReadFile,1,1,,,yes,2,,,,,4
WSARecv,1,1,,,yes,2,,,,,5
BIO_read,1,1,,yes,yes,2,,,,,4
strcpy,,0,1,,,,,,buffer_overflow,1,8
strcat,,0,1,,,,,,buffer_overflow,1,7
sprintf,,0,,,,,,,buffer_overflow,0,7
vsprintf,,0,,,,,,,buffer_overflow,0,7
wcscpy,,0,1,,,,,,buffer_overflow,1,7
wcscat,,0,1,,,,,,buffer_overflow,1,7
strncpy,,0,1,,yes,2,,,,,3
strncat,,0,1,,yes,2,,,,,3
snprintf,,0,,,yes,1,,,,,2
vsnprintf,,0,,,yes,1,,,,,2
strlcpy,,0,1,,yes,2,,,,,2
strlcat,,0,1,,yes,2,,,,,2
wcsncat,,0,1,,yes,2,,,,,3
wcsncpy,,0,1,,yes,2,,,,,3
memcpy,,0,1,,yes,2,,,buffer_overflow,2,5
memmove,,0,1,,yes,2,,,buffer_overflow,2,5
mempcpy,,0,1,yes,yes,2,,,,,4
memcpy_s,,0,2,,yes,1,,,,,3
memmove_s,,0,2,,yes,1,,,,,3
bcopy,,1,0,,yes,2,,,buffer_overflow,2,5
png_memcpy,,0,1,,yes,2,,,buffer_overflow,2,5
memset,,0,,,yes,2,,,,,1
printf,,,,,,,,,format_string,0,6
fprintf,,,,,,,,,format_string,1,6
vprintf,,,,,,,,,format_string,0,6
vfprintf,,,,,,,,,format_string,1,6
syslog,,,,,,,,,format_string,1,5
err,,,,,,,,,format_string,1,4
warn,,,,,,,,,format_string,0,4
system,,,,,,,,,command_injection,0,10
popen,,,,yes,,,,,command_injection,0,9
execve,,,,,,,,,command_injection,0,10
execl,,,,,,,,,command_injection,0,10
execlp,,,,,,,,,command_injection,0,10
execv,,,,,,,,,command_injection,0,10
execvp,,,,,,,,,command_injection,0,10
ShellExecute,,,,,,,,,command_injection,2,9
CreateProcess,,,,,,,,,command_injection,1,9
malloc,,,,,,0,,yes,integer_overflow,0,3
calloc,,,,,,0 1,,yes,integer_overflow,,4
realloc,,,,,,1,,yes,integer_overflow,1,4
reallocarray,,,,,,1 2,,yes,integer_overflow,,4
valloc,,,,,,0,,yes,,,3
pvalloc,,,,,,0,,yes,,,3
mmap,,,,,,1,,yes,,,3
mmap64,,,,,,1,,yes,,,3
HeapAlloc,,,,,,2,,yes,,,3
VirtualAlloc,,,,,,1,,yes,,,3
LocalAlloc,,,,,,1,,yes,,,3
GlobalAlloc,,,,,,1,,yes,,,3
xmalloc,,,,,,0,,yes,,,3
zmalloc,,,,,,0,,yes,,,3
smalloc,,,,,,0,,yes,,,3
emalloc,,,,,,0,,yes,,,3
operator new,,,,,,0,,yes,,,3
operator new[],,,,,,0,,yes,,,3
png_malloc,,,,,,1,,yes,integer_overflow,1,3
png_malloc_warn,,,,,,1,,yes,integer_overflow,1,3
png_calloc,,,,,,1,,yes,integer_overflow,1,3
png_malloc_base,,,,,,1,,yes,,,3
png_realloc_array,,,,,,2 3,,yes,integer_overflow,2,4
png_zalloc,,,,,,1,,yes,,,3
g_malloc,,,,,,0,,yes,,,3
g_malloc0,,,,,,0,,yes,,,3
g_malloc_n,,,,,,0 1,,yes,integer_overflow,,4
g_realloc,,,,,,1,,yes,,,3
g_try_malloc,,,,,,0,,yes,,,3
g_new,,,,,,1,,yes,,,3
g_new0,,,,,,1,,yes,,,3
free,,,,,,,0,,,,2
cfree,,,,,,,0,,,,2
png_free,,,,,,,1,,,,2
png_free_data,,,,,,,2,,,,2
g_free,,,,,,,0,,,,2
png_read_data,1,1,,,yes,2,,,,,4
png_read_row,,1,,,,,,,,,3
png_read_rows,,1,,,yes,3,,,,,3
png_safe_execute,,,,,,,,,null_dereference,1,4
psf_binheader_readf,,pointers,,,,,,,,,4
psf_fread,0,0,,yes,yes,1 2,,,,,4
TIFFGetField,,pointers,,,,,,,,,4
TIFFReadRawTile,1,1,,yes,yes,2,,,,,4
TIFFReadEncodedTile,1,1,,yes,yes,2,,,,,4
TIFFReadRawStrip,1,1,,yes,yes,2,,,,,4
TIFFReadEncodedStrip,1,1,,yes,yes,2,,,,,4
_TIFFmalloc,,,,,,0,,yes,integer_overflow,0,3
_TIFFrealloc,,,,,,1,,yes,integer_overflow,1,3
_TIFFfree,,,,,,,0,,,,2
_TIFFmemcpy,,0,1,,yes,2,,,buffer_overflow,2,5
xmlGetProp,,,,yes,,,,,,,3
xmlNodeGetContent,,,,yes,,,,,,,3
xmlStrndup,,,,yes,,,,yes,,,3
xmlMalloc,,,,,,0,,yes,integer_overflow,0,3
xmlMallocAtomic,,,,,,0,,yes,,,3
xmlRealloc,,,,,,1,,yes,,,3
xmlFree,,,,,,,0,,,,2
xmlMemMalloc,,,,,,0,,yes,,,3
xmlMemRealloc,,,,,,1,,yes,,,3
xmlMemFree,,,,,,,0,,,,2
xmlParserInputBufferRead,0,0,,,,,,,,,4
xmlParserInputBufferPush,2,2,,,,,,,,,4
xmlParseChunk,1,1,,,,,,,,,4
php_stream_read,1,1,,,,,,,,,4
_php_stream_read,1,1,,,,,,,,,4
php_stream_gets,1,1,,,,,,,,,4
php_stream_fill_read_buffer,0,0,,,,,,,,,3
zend_stream_read,1,1,,,,,,,,,4
sqlite3_value_text,,,,yes,,,,,,,3
sqlite3_value_blob,,,,yes,,,,,,,3
sqlite3_value_int,,,,yes,,,,,,,2
sqlite3_value_int64,,,,yes,,,,,,,2
sqlite3_column_text,,,,yes,,,,,,,3
sqlite3_column_blob,,,,yes,,,,,,,3
sqlite3_column_int,,,,yes,,,,,,,2
sqlite3_column_int64,,,,yes,,,,,,,2
sqlite3Malloc,,,,,,0,,yes,integer_overflow,0,3
sqlite3Realloc,,,,,,1,,yes,,,3
sqlite3MallocZero,,,,,,0,,yes,,,3
sqlite3DbMalloc,,,,,,1,,yes,,,3
sqlite3DbMallocZero,,,,,,1,,yes,,,3
sqlite3DbRealloc,,,,,,2,,yes,,,3
sqlite3_free,,,,,,,0,,,,2
lua_tostring,,,,yes,,,,,,,3
lua_tolstring,,,,yes,,,,,,,3
lua_tointeger,,,,yes,,,,,,,2
lua_tonumber,,,,yes,,,,,,,2
luaM_malloc,,,,,,1,,yes,,,3
luaM_realloc,,,,,,2,,yes,,,3
OPENSSL_malloc,,,,,,0,,yes,integer_overflow,0,3
OPENSSL_realloc,,,,,,1,,yes,,,3
OPENSSL_free,,,,,,,0,,,,2
CRYPTO_malloc,,,,,,0,,yes,integer_overflow,0,3
CRYPTO_realloc,,,,,,1,,yes,,,3
CRYPTO_free,,,,,,,0,,,,2
strlen,,,,yes,,,,,,,1
strnlen,,,,yes,yes,1,,,,,1
wcslen,,,,yes,,,,,,,1
strcmp,,,,,,,,,,,1
strncmp,,,,,yes,2,,,,,1
memcmp,,,,,yes,2,,,,,1
fopen,,,,,,,,,,,1
fclose,,,,,,,,,,,1
fwrite,,,0,,yes,1 2,,,,,1
write,,,1,,yes,2,,,,,1
send,,,1,,yes,2,,,,,1
atoi,,,,yes,,,,,,,2
atol,,,,yes,,,,,,,2
atoll,,,,yes,,,,,,,2
strtol,,,,yes,,,,,,,2
strtoul,,,,yes,,,,,,,2
strtoll,,,,yes,,,,,,,2
strtoull,,,,yes,,,,,,,2
strtod,,,,yes,,,,,,,2
"""
RULE_CONFIDENCE = 0.95
RULE_SCHEMA = "rule_fn string, external_input array<int>, writes_at int, writes_all_ptr boolean, reads_from int, return_tainted boolean, bounded boolean, size_args array<int>, frees_at int, return_is_buffer boolean, sink boolean, sink_type string, taint_arg int, confidence double, vuln_score double"


def rule_rows() -> list[tuple]:
    """The catalog as rows of RULE_SCHEMA; -1 is no argument."""
    rows = []
    for r in csv.DictReader(RULES_CSV.strip().splitlines()):
        ints = lambda k: [int(x) for x in r[k].split()]  # noqa: E731, B023
        at = lambda k: int(r[k]) if r[k].isdigit() else -1  # noqa: E731, B023
        yes = lambda k: r[k] == "yes"  # noqa: E731, B023
        rows.append(
            (r["name"], ints("external_input"), at("writes_at"), r["writes_at"] == "pointers", at("reads_from"), yes("return_tainted"), yes("bounded"), ints("size_args"), at("frees_at"), yes("return_is_buffer"), r["sink_type"] != "", r["sink_type"], at("taint_arg"), RULE_CONFIDENCE, float(r["vuln_score"]))
        )
    return rows


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


# Role name patterns, first role with a matching pattern wins.
ROLE_PATTERNS = {
    "error_handler": "error err_ _err warning warn_ fatal abort_ _abort panic cleanup _cleanup exception",
    "checksum": "crc hash checksum digest hmac sha md5 adler fletcher",
    "decoder": "decode decrypt decompress inflate unpack base64 unescape urldecode deobfuscat",
    "validator": "check_ _check validate verify assert_ guard bound limit_ _limit sanity ensure is_valid clamp is_safe",
    "parser": "parse parser lex scan_ _scan tokenize _parse read_ _read load_ _load select query stmt handle_ _handle process_ _process",
    "serializer": "write_ _write encode serialize pack_ _pack emit_ _emit output_ format_ print_",
    "allocator": "alloc malloc new_ create_ _new _create init_ _init setup_ construct",
    "iterator": "foreach iter_ _iter _next next_ walk_ _walk traverse visit",
    "state_machine": "state_ _state fsm transition switch_state process_event dispatch_event",
    "dispatcher": "dispatch route_ _route callback event_ _event signal_ handler",
    "math": "sqrt pow_ _pow log_ _log _math sin_ cos_ mul_ div_ mod_",
    "wrapper": "wrapper _wrapper wrap_ _wrap",
}
# Budget category of a role, and base share of the budget of a category.
ROLE_CATEGORY = {
    "parser": "parser", "decoder": "parser", "validator": "validator", "state_machine": "state_machine", "dispatcher": "state_machine", "error_handler": "error_handler",
    "allocator": "memory", "wrapper": "memory", "iterator": "memory", "serializer": "memory", "checksum": "unknown", "math": "unknown", "unknown": "unknown",
}
QUOTA_SHARE = {"parser": 0.233, "validator": 0.200, "arithmetic": 0.167, "memory": 0.133, "unknown": 0.133, "state_machine": 0.067, "error_handler": 0.067}
# Source roles by exact name, in the order they are tried, their confidence, and fallbacks by substring.
SOURCE_ROLES = {
    "DIRECT_IO": "recv recvfrom recvmsg read fread fgets gets scanf sscanf fscanf getline readline",
    "NETWORK_WRAPPED": "BIO_read SSL_read SSL_read_ex ReadFile WSARecv WSARecvFrom",
    "LIBRARY_READER": "png_crc_read png_read_data png_get_uint_32 png_get_uint_16 png_read_chunk_header png_read_buffer TIFFReadDirectory TIFFGetField TIFFGetFieldDefaulted TIFFReadRawStrip TIFFReadEncodedStrip xmlGetProp xmlGetNsProp xmlNodeGetContent xmlTextReaderRead xmlTextReaderGetAttribute psf_fread psf_binheader_readf psf_get_filelen EVP_DecryptUpdate EVP_DecodeUpdate",
    "PARSER_CALLBACK": "xmlReadFile xmlReadDoc xmlParseDoc xmlParseFile xmlInputReadCallback xmlTextReaderRead",
    "DB_INPUT": "sqlite3_value_text sqlite3_value_blob sqlite3_value_int sqlite3_value_int64 sqlite3_value_double sqlite3_value_bytes sqlite3_column_text sqlite3_column_blob sqlite3_column_bytes sqlite3_column_int sqlite3_str_vappendf",
    "CLI_ARGUMENT": "getopt getopt_long getopt_long_only poptGetArg optarg",
    "ENVIRONMENT": "getenv secure_getenv cuserid getlogin getlogin_r",
}
SOURCE_CONFIDENCE = {"DIRECT_IO": 1.00, "NETWORK_WRAPPED": 0.98, "LIBRARY_READER": 0.90, "PARSER_CALLBACK": 0.90, "DB_INPUT": 0.85, "CLI_ARGUMENT": 0.75, "ENVIRONMENT": 0.65, "UNKNOWN": 0.00}
NOT_SOURCES = "malloc calloc realloc free memcpy memset memmove strlen printf fprintf sprintf png_malloc _TIFFmalloc xmlMalloc".split()
SOURCE_FALLBACKS = [
    ("_callback", "PARSER_CALLBACK"), ("_handler", "PARSER_CALLBACK"), ("_readf", "LIBRARY_READER"), ("_reader", "LIBRARY_READER"), ("_read_", "LIBRARY_READER"), ("_parse_", "PARSER_CALLBACK"),
    ("_decode_", "LIBRARY_READER"), ("_input_", "LIBRARY_READER"), ("_recv", "DIRECT_IO"), ("_receive", "DIRECT_IO"), ("_fetch_", "LIBRARY_READER"),
]
# Sink classes by name, in the order they are tried.
SINK_CLASSES = {
    "ALLOCATOR": ["malloc", "calloc", "realloc", "reallocarray", "valloc", "pvalloc", "mmap", "mmap64", "brk", "png_malloc", "png_malloc_warn", "png_calloc", "png_malloc_base", "png_realloc_array", "png_zalloc", "_TIFFmalloc", "_TIFFrealloc", "_TIFFcalloc", "xmlMalloc", "xmlRealloc", "xmlMallocAtomic", "g_malloc", "g_malloc0", "g_malloc_n", "g_realloc", "sqlite3_malloc", "sqlite3_malloc64", "sqlite3_realloc", "xmalloc", "zmalloc", "emalloc", "HeapAlloc", "VirtualAlloc", "LocalAlloc", "operator new", "operator new[]"],
    "COPY": ["memcpy", "memmove", "bcopy", "memcpy_s", "memmove_s", "strcpy", "strcat", "stpcpy", "strcpy_s", "strcat_s", "png_memcpy", "png_memset", "wmemcpy", "wmemmove"],
    "FORMAT": ["printf", "fprintf", "sprintf", "snprintf", "vprintf", "vfprintf", "vsprintf", "vsnprintf", "wprintf", "fwprintf", "swprintf"],
    "FREE": ["free", "g_free", "png_free", "xmlFree", "TIFFClose", "sqlite3_free", "_TIFFfree", "operator delete", "operator delete[]"],
}
# Parts of the name-independent shape of a candidate: words of external origins, families of sinks by what
# their lower-cased names contain (begin with, for those marked ^), in the order they are tried, words for match kinds, and
# buckets of confidence.
SHAPE_EXTERNAL = ["fread", "recv", "read", "BIO_read", "TIFFGetField", "sqlite3_value", "xmlGetProp", "lua_to"]
SHAPE_FAMILIES = {
    "memcpy_family": ["memcpy", "memmove", "mempcpy", "bcopy"],
    "malloc_family": ["malloc", "realloc", "calloc", "alloc"],
    "callind_null": ["callind", "^var_"],
    "ptradd_oob": ["ptradd"],
    "int_and_trunc": ["int_and"],
    "load_null": ["load"],
}
SHAPE_MATCH = {"LIBRARY_MATCH": "lib", "STRUCTURAL_MATCH": "struct", "NO_MATCH": "heur"}
SHAPE_CONFIDENCE = {"high": 0.7, "med": 0.45, "low": 0.0}
# Imports that bring attacker data in, and sinks that are dangerous whatever their arguments.
TAINT_SOURCES = "recv recvfrom read fread fgets scanf sscanf fscanf getenv ReadFile WSARecv gets".split()
TAINT_SINKS = "strcpy strcat sprintf vsprintf gets memcpy memmove mempcpy wmemcpy strncat strncpy snprintf vsnprintf system popen execl execle execlp execv execve execvp printf fprintf wprintf".split()
# Groups of operation mnemonics; others are `other`.
OP_GROUPS = {
    "mem_read": "LOAD", "mem_write": "STORE", "arith": "INT_ADD INT_SUB INT_MULT INT_DIV INT_REM INT_NEGATE FLOAT_ADD FLOAT_SUB", "logic": "INT_AND INT_OR INT_XOR INT_NOTT BOOL_AND BOOL_OR",
    "cmp": "INT_EQUAL INT_NOTEQUAL INT_LESS INT_LESSEQUAL INT_SLESS INT_SLESSEQUAL", "ptr": "PTRADD PTRSUB", "cast": "INT_ZEXT INT_SEXT", "shift": "INT_LSHIFT INT_RSHIFT",
    "branch": "CBRANCH BRANCH BRANCHIND", "call": "CALL", "indirect_call": "CALLIND", "phi": "MULTIEQUAL", "return": "RETURN", "copy": "COPY PIECE SUBPIECE",
}
SKIPPED_OPS = "CAST PIECE SUBPIECE INDIRECT MULTIEQUAL".split()
ARITHMETIC_OPS = "INT_ADD INT_SUB INT_MULT INT_DIV INT_REM INT_LEFT INT_RIGHT INT_SRIGHT PTRADD PTRSUB INT_ZEXT INT_SEXT".split()
# Default severity of a vulnerability type (others medium) and the order of severities.
SEVERITY = {"buffer_overflow": "high", "command_injection": "critical", "format_string": "high", "write_what_where": "critical", "integer_overflow": "medium", "use_after_free": "high"}
SEVERITIES = ["info", "low", "medium", "high", "critical"]
# Weights of the calibrated confidence, and how far a source string is trusted (first substring wins).
CALIBRATION = {"llm": 0.40, "pattern": 0.25, "taint": 0.20, "source": 0.10, "verification": 0.05}
SOURCE_TRUST = [
    ("external:fread", 1.00), ("external:recv", 1.00), ("external:read", 1.00), ("external:fgets", 1.00), ("external:getenv", 0.95), ("external:scanf", 0.95), ("external:png_crc_read", 0.95),
    ("external:psf_binheader", 0.95), ("external:llm_source", 0.75), ("structural:callind", 0.65), ("structural:load_load", 0.65), ("structural:", 0.60), ("param:", 0.30), ("unknown_call:", 0.35), ("interprocedural:", 0.55),
]
SOURCE_TRUST_DEFAULT = 0.45


def group_of() -> dict[str, str]:
    """Group of each mnemonic."""
    return {op: group for group, ops in OP_GROUPS.items() for op in ops.split()}


def role_patterns(spark: SparkSession) -> DataFrame:
    """role_ord, pat_ord, pattern, role, role_conf (0.90 for patterns of six letters or more, else 0.75)."""
    rows = [(i, j, p, role, 0.90 if len(p) >= 6 else 0.75) for i, (role, ps) in enumerate(ROLE_PATTERNS.items()) for j, p in enumerate(ps.split())]
    return spark.createDataFrame(rows, "role_ord int, pat_ord int, pattern string, role string, role_conf double")
