"""URL expressions: resolution against a base, host, site notions, fragments.

Parsing uses the RFC 3986 splitting pattern with ``regexp_extract`` so the
same parts are available for any scheme; everything stays JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column

from pagefold.functions.core import _ids, col, let, lit

URL_RE = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME_RE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
# --- fixed values: schemes that get WHATWG "special" normalization ---------
SPECIAL_SCHEMES = ["http", "https", "ws", "wss", "ftp"]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
# --- end fixed values -------------------------------------------------------


def _parts_sql(u: str) -> str:
    """named_struct(scheme, has_auth, auth, path, query, frag, ok, raw)."""
    r = lit(URL_RE)
    return let(u, lambda x: (
        f"named_struct('scheme', regexp_extract({x}, {r}, 1), 'has_auth', regexp_extract({x}, {r}, 2) != '', "
        f"'auth', regexp_extract({x}, {r}, 3), 'path', regexp_extract({x}, {r}, 4), "
        f"'query', regexp_extract({x}, {r}, 5), 'frag', regexp_extract({x}, {r}, 6), "
        f"'ok', {x} RLIKE {r}, 'raw', {x})"))


def fold_dots_sql(path: str) -> str:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    n = next(_ids)
    acc, seg = f"_a{n}", f"_s{n}"

    def body(p: str) -> str:
        return let(f"split(substring({p}, 2), '/')", lambda segs: let(
            f"aggregate({segs}, cast(array() AS array<string>), ({acc}, {seg}) -> "
            f"CASE WHEN {seg} = '..' THEN slice({acc}, 1, greatest(size({acc}) - 1, 0)) "
            f"WHEN {seg} = '.' THEN {acc} ELSE concat({acc}, array({seg})) END)",
            lambda f: (f"CASE WHEN size({f}) = 0 THEN '/' ELSE concat('/', array_join({f}, '/'), "
                       f"CASE WHEN element_at({segs}, -1) IN ('.', '..') THEN '/' ELSE '' END) END")))
    return let(path, body)


def _normalize_abs_sql(p: str) -> str:
    """Normalize an absolute URL given its ``_parts_sql`` struct."""
    specials = ", ".join(lit(s) for s in SPECIAL_SCHEMES)
    dport = "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in DEFAULT_PORTS.items()) + ")"

    def with_host(hp: str) -> str:
        scheme = f"lower({p}.scheme)"
        host = f"lower(regexp_extract({hp}, {lit(r'^(\[[^\]]*\]|[^:]*)')}, 1))"
        port = f"regexp_extract({hp}, {lit(r'^(?:\[[^\]]*\]|[^:]*):(\d*)$')}, 1)"
        port_out = let(port, lambda pt: f"CASE WHEN {pt} = '' OR {pt} = try_element_at({dport}, {scheme}) THEN '' ELSE concat(':', {pt}) END")
        path = f"CASE WHEN {p}.path = '' THEN '/' ELSE {fold_dots_sql(p + '.path')} END"
        userinfo = f"regexp_extract({p}.auth, '^([^@]*@)?', 1)"
        return let(host, lambda h: (
            f"CASE WHEN {scheme} IN ({specials}) AND {p}.has_auth AND {h} != '' THEN "
            f"replace(concat({scheme}, '://', {userinfo}, {h}, {port_out}, {path}, {p}.query, {p}.frag), ' ', '%20') "
            f"WHEN {scheme} IN ({specials}) THEN NULL "
            f"ELSE concat({scheme}, ':', regexp_replace({p}.raw, {lit(SCHEME_RE)}, '')) END"))

    return let(f"regexp_replace({p}.auth, '^[^@]*@', '')", with_host)


def resolve_url_sql(base: str, href: str) -> str:
    """Absolute URL of ``href`` against ``base``; NULL when it cannot resolve."""
    h0 = f"regexp_replace(regexp_replace({href}, {lit(r'^[\x{00}-\x{20}]+|[\x{00}-\x{20}]+$')}, ''), {lit(r'[\t\n\r]')}, '')"

    def body(x: str) -> str:
        h, b = f"{x}.h", f"{x}.b"
        origin = f"concat({b}.scheme, '://', {b}.auth)"
        bpath = f"CASE WHEN {b}.path = '' THEN '/' ELSE {b}.path END"
        bdir = f"regexp_replace({bpath}, '[^/]*$', '')"
        return (f"CASE WHEN {h} RLIKE {lit(SCHEME_RE)} THEN {h} "
                f"WHEN NOT ({b}.ok AND {b}.has_auth) THEN CAST(NULL AS STRING) "
                f"WHEN startswith({h}, '//') THEN concat({b}.scheme, ':', {h}) "
                f"WHEN startswith({h}, '/') THEN concat({origin}, {h}) "
                f"WHEN startswith({h}, '?') THEN concat({origin}, {bpath}, {h}) "
                f"WHEN startswith({h}, '#') THEN concat({origin}, {bpath}, {b}.query, {h}) "
                f"WHEN {h} = '' THEN concat({origin}, {bpath}, {b}.query) "
                f"ELSE concat({origin}, {bdir}, {h}) END")

    target = let(f"named_struct('h', {h0}, 'b', {_parts_sql(base)})", body)
    return let(_parts_sql(target), lambda t: f"CASE WHEN {t}.ok THEN {_normalize_abs_sql(t)} END")


def url_host_sql(u: str) -> str:
    """Lower-case host of an absolute URL ('' when there is none)."""
    return f"lower(regexp_extract({u}, {lit(r'^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)')}, 1))"


def registrable_ish_sql(host: str) -> str:
    """Last two non-empty labels, lower case; two or fewer labels unchanged."""
    n = next(_ids)
    return let(f"filter(split(lower({host}), '\\\\.'), _l{n} -> _l{n} != '')", lambda parts: (
        f"CASE WHEN size({parts}) <= 2 THEN array_join({parts}, '.') "
        f"ELSE array_join(slice({parts}, -2, 2), '.') END"))


def same_site_sql(a: str, b: str) -> str:
    """Both URLs absolute and their ``registrable_ish`` hosts equal."""
    r = lit(URL_RE)
    return let(f"named_struct('a', {a}, 'b', {b})", lambda x: (
        f"coalesce({x}.a RLIKE {r} AND {x}.b RLIKE {r} AND "
        f"{registrable_ish_sql(url_host_sql(x + '.a'))} = {registrable_ish_sql(url_host_sql(x + '.b'))}, false)"))


def strip_fragment_sql(u: str) -> str:
    return f"regexp_replace({u}, '(?s)#.*$', '')"


def url_equal_ignoring_fragment_sql(a: str, b: str) -> str:
    """Equal once the fragment is removed; raw comparison when unparseable."""
    r = lit(URL_RE)
    return let(f"named_struct('a', {a}, 'b', {b})", lambda x: (
        f"CASE WHEN {x}.a RLIKE {r} AND {x}.b RLIKE {r} THEN "
        f"{strip_fragment_sql(x + '.a')} = {strip_fragment_sql(x + '.b')} ELSE {x}.a = {x}.b END"))


def resolve_url(base: str, href: str) -> Column:
    return col(resolve_url_sql(base, href))


def url_host(u: str) -> Column:
    return col(url_host_sql(u))


def registrable_ish(host: str) -> Column:
    return col(registrable_ish_sql(host))


def same_site(a: str, b: str) -> Column:
    return col(same_site_sql(a, b))


def strip_fragment(u: str) -> Column:
    return col(strip_fragment_sql(u))


def url_equal_ignoring_fragment(a: str, b: str) -> Column:
    return col(url_equal_ignoring_fragment_sql(a, b))
