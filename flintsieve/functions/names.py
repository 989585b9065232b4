"""Rules on names: feature groups, proxy flags, function kinds, safe names. Plain Python for column names, which are
known when a plan is made, and columns for data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from flintsieve.functions import constants as C

# Beginnings and words of feature names by group, tried in this order. Three variants are in use.
_OPCODE = ("opcode_like", ["pcode_", "mnemonic_"])
_SUMMARY = ("v6_summary", ["v6_summary_", "v6_loop_summary_", "v6_function_role_"])
_SINK = ("v6_sink", ["sinks_v6_"])
_SUMMED = ("sink_buffer_summary", ["sink_summary_", "buffer_summary_", "v4_summary_"])
_RAW = ("raw_buffer_alias", ["local_buffers_", "v6_aliases_"])
_STATIC = ("program_static", ["stack_", "cfg_", "summary_", "callgraph_"])
_RISK, _FLOW = ["risk", "safe", "guard", "overflow"], ["dst", "src", "source", "size", "sink"]
VARIANTS = {
    "selector": ([_OPCODE, _RAW, _SUMMARY, _SINK, _SUMMED, _STATIC], [("risk_safe", _RISK, True)]),
    "analysis": ([_OPCODE, _RAW, _SINK, _SUMMARY, _SUMMED, _STATIC], [("risk_safe", _RISK, False), ("dataflow_sink_size", _FLOW, False)]),
    "audit": (
        [_OPCODE, _SINK, _SUMMED, ("raw_buffer_alias", [*_RAW[1], "v6_alias_summary_"]), _SUMMARY, ("cfg_control_flow", ["cfg_"]), ("stack_memory", ["stack_"]), ("callgraph_context", ["callgraph_"])],
        [("risk_safe", [*_RISK, "bound", "check"], False), ("dataflow_sink_size", [*_FLOW, "line_index"], False)],
    ),
}


def feature_group(name: str, variant: str = "audit") -> str:
    begins, words = VARIANTS[variant]
    for group, starts in begins:
        if name.startswith(tuple(starts)):
            return group
    for group, parts, exact in words:
        if any(w in (name if exact else name.lower()) for w in parts):
            return group
    return "program_static" if variant == "audit" and name.startswith("summary_") else "other"


def feature_group_column(name: Column, variant: str = "audit") -> Column:
    begins, words = VARIANTS[variant]
    out = F
    for group, starts in begins:
        out = out.when(F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(name, s)), group)
    for group, parts, exact in words:
        searched = name if exact else F.lower(name)
        out = out.when(F.exists(F.array(*map(F.lit, parts)), lambda w: F.contains(searched, w)), group)  # noqa: B023  used at once
    if variant == "audit":
        out = out.when(F.startswith(name, F.lit("summary_")), "program_static")
    return out.otherwise("other")


# Words that mark a feature as a stand-in for size or place.
PROXIES = {
    "line_index": ["line_index"], "stack_offset": ["stack_offset"],
    "size_proxy": ["instruction_count", "decompiled_line_count", "line_count", "caller_names_count", "callee_names_count"],
    "generic_count": ["summary_instruction_count", "callgraph_caller_names_count"],
}
PENALTIES = {"line_index": 0.10, "stack_offset": 0.08, "size_proxy": 0.05, "generic_count": 0.04}


def proxy_flags_column(name: Column) -> Column:
    return F.concat_ws(",", *[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(name), w)), flag) for flag, words in PROXIES.items()])


# Functions of the compiler's runtime, and of the C library, by name; parts of runtime names.
RUNTIME = (
    "_start _init _fini frame_dummy __libc_start_main __cxa_finalize __cxa_atexit __gmon_start__ __gmon_start __do_global_dtors_aux deregister_tm_clones register_tm_clones "
    "__libc_csu_init __libc_csu_fini _dl_relocate_static_pie __stack_chk_fail __stack_chk_fail_local _ITM_registerTMCloneTable _ITM_deregisterTMCloneTable __TMC_END__ __dso_handle"
).split()
IMPORTED = (
    "puts putchar printf fprintf sprintf snprintf vprintf vsprintf vsnprintf scanf sscanf fscanf strcpy strncpy strcat strncat wcscpy wcsncpy wcscat wcsncat memcpy memmove memset memcmp "
    "gets fgets read recv recvfrom malloc calloc realloc free strlen strnlen strcmp strncmp strchr strstr exit abort perror"
).split()
RUNTIME_PARTS = ["tm_clone", "registertmclonetable", "deregistertmclonetable"]


def function_kind(name: Column) -> Column:
    """unknown, compiler_runtime, import_or_plt_api or user_candidate."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    bare = F.trim(F.substring_index(F.regexp_replace(raw, r"(@plt|\.plt|_plt)", ""), "@", 1))
    flat = F.regexp_replace(F.lower(bare), "[_.]", "")
    return (
        F.when(bare == "", "unknown").when(bare.isin(*RUNTIME), "compiler_runtime").when(bare.isin(*IMPORTED), "import_or_plt_api").when(raw.rlike(r"(@plt|\.plt|_plt)$"), "import_or_plt_api")
        .when(F.exists(F.array(*map(F.lit, C.RUNTIME_PREFIXES)), lambda p: F.startswith(bare, p)), "compiler_runtime").when(F.exists(F.array(*map(F.lit, RUNTIME_PARTS)), lambda w: F.contains(flat, w)), "compiler_runtime")
        .when(F.contains(F.lower(bare), F.lit("itm_")), "compiler_runtime").otherwise("user_candidate")
    )


def safe_name(text: Column) -> Column:
    """At most 120 characters of letters, digits and _.+-; other runs are one underscore; empty is `unknown`."""
    x = F.left(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_.+-]+", "_"), r"^_+|_+$", ""), F.lit(120))
    return F.when(x == "", "unknown").otherwise(x)


def key_name(text: str) -> str:
    """A part of a flattened column's name."""
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_")


def key_column(text: Column) -> Column:
    """key_name of a column."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_|_$", "")


def risk_level(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= C.HIGH, "HIGH").when(p >= C.MEDIUM, "MEDIUM").when(p >= threshold, "LOW").otherwise("SAFE")
