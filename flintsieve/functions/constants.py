"""Names, weights and cut-offs that results must agree on."""

# Call names by what they do, after normalisation of symbols.
DANGEROUS = [
    "gets", "memcpy", "memmove", "wmemcpy", "wmemmove", "read", "recv", "recvfrom", "sprintf", "swprintf", "vsprintf", "vswprintf", "sprintf_chk",
    "strcat", "strcpy", "wcscat", "wcscpy", "strcpy_chk", "strcat_chk",
]
BOUNDED = [
    "fgets", "fgetws", "snprintf", "vsnprintf", "snprintf_chk", "vsnprintf_chk", "strncpy", "strncat", "wcsncpy", "wcsncat", "strncpy_chk",
    "strncat_chk", "memcpy", "memmove", "wmemcpy", "wmemmove", "memcpy_chk", "memmove_chk", "strcpy_chk", "strcat_chk",
]
UNBOUNDED = ["gets", "sprintf", "swprintf", "vsprintf", "vswprintf", "strcpy", "strcat", "wcscpy", "wcscat"]
INPUT = ["gets", "fgets", "fgetws", "scanf", "sscanf", "fscanf", "isoc99_scanf", "isoc99_sscanf", "isoc23_scanf", "isoc23_sscanf", "read", "recv", "recvfrom"]
LENGTH = ["strlen", "wcslen", "strnlen", "wcsnlen", "sizeof"]
INIT = ["memset", "wmemset", "bzero"]
FORMAT = ["sprintf", "snprintf", "swprintf", "vsprintf", "vsnprintf", "vswprintf"]

# Places of the destination, source and size arguments; -1 is none. Others have none at all.
ROLES = {
    (0, 1, -1): ["strcpy", "strcat", "wcscpy", "wcscat"],
    (0, 1, 2): ["memcpy", "memmove", "wmemcpy", "wmemmove", "memcpy_chk", "memmove_chk", "strncpy", "strncat", "wcsncpy", "wcsncat", "strncpy_chk", "strncat_chk", "strcpy_chk", "strcat_chk"],
    (0, -1, 2): ["memset", "wmemset", "sprintf_chk"],
    (0, -1, 1): ["snprintf", "vsnprintf", "snprintf_chk", "vsnprintf_chk", "fgets", "fgetws"],
    (0, -1, -1): ["sprintf", "swprintf"],
    (1, -1, 2): ["read", "recv", "recvfrom"],
}

# Bytes of a type by the first of these words that its lower-case name contains; else 1.
TYPE_BYTES = [
    ("wchar", 4), ("char16", 2), ("char32", 4), ("char", 1), ("byte", 1), ("undefined", 1), ("short", 2), ("int64", 8),
    ("long long", 8), ("uint64", 8), ("int", 4), ("long", 8), ("float", 4), ("double", 8),
]
# Words of an expression that stands for outside input.
INPUT_WORDS = ["argv", "envp", "getenv", "stdin", "read", "recv", "scanf", "fgets", "gets"]
INPUT_SOURCES = ["argv", "envp", "getenv", "stdin", "scanf", "sscanf", "fscanf", "fgets", "gets", "read", "recv", "recvfrom", "getchar"]
LENGTH_WORDS = ["strlen", "wcslen", "strnlen", "wcsnlen", "sizeof"]
BOUND_WORDS = ["len", "size", "count", "bound"]

# Patterns of declarations, calls and literals.
BUFFER = (
    r"\b((?:const\s+|static\s+|unsigned\s+|signed\s+|volatile\s+)*"
    r"(?:char|wchar_t|char16_t|char32_t|byte|undefined|int|uint|int64_t|uint64_t|long|short|float|double)[\w\s\*]*)\s+"
    r"([A-Za-z_]\w*)\s*\[\s*(0x[0-9a-fA-F]+|\d+)\s*\]"
)
CALL = r"\b([A-Za-z_]\w*)\s*\((.*)\)\s*;"
LOOP = r"\b(for|while)\s*\("
LITERAL = r'L?"((?:\\.|[^"\\])*)"'
CAST = r"\(\s*(?:size_t|ssize_t|int|uint|uint32_t|uint64_t|long|ulong|unsigned\s+int|unsigned\s+long|longlong|ulonglong)\s*\)"
SUM = r"(?i)^[+-]?(?:0x[0-9a-f]+|\d+)(?:[+-](?:0x[0-9a-f]+|\d+))*$"

# Risk levels, and weights of a static finding.
HIGH, MEDIUM = 0.85, 0.65
ALWAYS_UNBOUNDED = ["strcpy", "strcat", "gets", "sprintf", "vsprintf"]

# Calls that may be findings; of them copies with a bound; words of safe evidence.
FINDABLE = ["strcpy", "strcat", "gets", "sprintf", "vsprintf", "memcpy", "memmove", "strncpy", "strncat", "scanf", "sscanf", "fscanf", "read", "recv", "recvfrom", "snprintf", "vsnprintf", "wcscpy", "wcscat", "wmemcpy", "wmemmove"]
COPIES = ["memcpy", "memmove", "strncpy", "strncat", "scanf", "sscanf", "fscanf", "read", "recv", "recvfrom"]
SAFE_WORDS = ["safe_proof", "strong_guard", "size_lt_dst", "size_eq_dst", "size_le_dst", "sizeof", "guard", "bound", "check", "literal_copy_safe"]

# Beginnings of runtime names.
RUNTIME_PREFIXES = ["__x86.get_pc_thunk", "__libc_", "__cxa_", "__gmon_", "_Unwind_"]

# Share of each group among selected features, bonus of a group, weight of a group.
QUOTAS = {
    "v6_sink": 0.27, "risk_safe": 0.20, "sink_buffer_summary": 0.12, "v6_summary": 0.12, "raw_buffer_alias": 0.10, "dataflow_sink_size": 0.08,
    "opcode_like": 0.06, "stack_memory": 0.04, "program_static": 0.01, "callgraph_context": 0.0, "cfg_control_flow": 0.0,
}
BONUSES = {
    "v6_sink": 0.08, "risk_safe": 0.07, "sink_buffer_summary": 0.07, "v6_summary": 0.06, "raw_buffer_alias": 0.06, "stack_memory": 0.06,
    "dataflow_sink_size": 0.02, "opcode_like": 0.0, "program_static": -0.04, "callgraph_context": -0.06, "cfg_control_flow": -0.10,
}
CORE_GROUPS = ["v6_sink", "sink_buffer_summary", "risk_safe", "stack_memory", "raw_buffer_alias", "v6_summary"]
