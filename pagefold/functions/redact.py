"""Redaction expressions for captured metadata (headers, log lines)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from pagefold.functions.core import _ids, col, lit

# --- fixed values ----------------------------------------------------------
ALWAYS_REDACTED = ["cookie", "set-cookie", "authorization", "proxy-authorization"]
REDACTED_SUFFIXES = ["-token", "-secret"]
REDACTED_VALUE = "[redacted]"
SECRET_MASK = "***"
# --- end fixed values -------------------------------------------------------

USERINFO_RE = r"://([^/?#\s:@]*):[^/?#\s@]*@"


def is_sensitive_header_sql(name: str) -> str:
    names = ", ".join(lit(h) for h in ALWAYS_REDACTED)
    ends = " OR ".join(f"endswith(lower({name}), {lit(s)})" for s in REDACTED_SUFFIXES)
    return f"(lower({name}) IN ({names}) OR {ends})"


def redact_headers_sql(headers: str) -> str:
    """``map<string,string>`` with credential-bearing values replaced."""
    n = next(_ids)
    k, v = f"_k{n}", f"_hv{n}"
    return f"transform_values({headers}, ({k}, {v}) -> CASE WHEN {is_sensitive_header_sql(k)} THEN {lit(REDACTED_VALUE)} ELSE {v} END)"


def redact_header_value_sql(name: str, value: str) -> str:
    return f"CASE WHEN {is_sensitive_header_sql(name)} THEN {lit(REDACTED_VALUE)} ELSE {value} END"


def redact_userinfo_sql(text: str) -> str:
    """Mask the password of every ``scheme://user:pass@`` in free text."""
    return f"regexp_replace({text}, {lit(USERINFO_RE)}, '://$1:***@')"


def masked_sql(path: str, dtype: DataType, mask: str = SECRET_MASK, sort: bool = False) -> str:
    """``path`` with every struct field (and string map key) whose name ends in
    ``_secret`` replaced by ``mask``, at any depth; fields sorted if asked."""
    def hides(t) -> bool:
        if isinstance(t, StructType):
            return sort or any(f.name.endswith("_secret") or hides(f.dataType) for f in t.fields)
        if isinstance(t, ArrayType):
            return hides(t.elementType)
        return isinstance(t, MapType) and (isinstance(t.keyType, StringType) or hides(t.valueType))

    if not hides(dtype):
        return path
    if isinstance(dtype, StructType):
        parts = []
        for f in sorted(dtype.fields, key=lambda f: f.name) if sort else dtype.fields:
            sub = f"{path}.`{f.name}`"
            value = f"CAST({lit(mask)} AS STRING)" if f.name.endswith("_secret") else masked_sql(sub, f.dataType, mask, sort)
            parts.append(f"{lit(f.name)}, {value}")
        return f"CASE WHEN {path} IS NULL THEN NULL ELSE named_struct({', '.join(parts)}) END"
    n = next(_ids)
    if isinstance(dtype, ArrayType):
        return f"transform({path}, _e{n} -> {masked_sql(f'_e{n}', dtype.elementType, mask, sort)})"
    value = masked_sql(f"_v{n}", dtype.valueType, mask, sort)
    if isinstance(dtype.keyType, StringType) and isinstance(dtype.valueType, StringType):
        value = f"CASE WHEN endswith(_m{n}, '_secret') THEN {lit(mask)} ELSE {value} END"
    elif isinstance(dtype.keyType, StringType):
        value = f"CASE WHEN endswith(_m{n}, '_secret') THEN NULL ELSE {value} END"
    return f"transform_values({path}, (_m{n}, _v{n}) -> {value})"


def is_sensitive_header(name: str) -> Column:
    return col(is_sensitive_header_sql(name))


def redact_headers(headers: str) -> Column:
    return col(redact_headers_sql(headers))


def redact_header_value(name: str, value: str) -> Column:
    return col(redact_header_value_sql(name, value))


def redact_userinfo(text: str) -> Column:
    return col(redact_userinfo_sql(text))
