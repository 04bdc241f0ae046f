"""Cookie observations -> jar, expiry, URL matching, headers.

Jar rows: ``name, value, domain, host_only, path, expires_epoch_s, secure,
http_only, same_site, seq``. "Newest wins by identity" is an aggregate
(``max_by(row, seq)`` per identity), which combines map-side. Matching a
cookie to a URL is a theta join made equi: each URL's host is exploded into
its dot-suffixes and joined to the jar on ``domain``; host-only, path,
secure and expiry are residual predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.core import lit

JAR_COLS = ["name", "value", "domain", "host_only", "path", "expires_epoch_s", "secure", "http_only", "same_site"]
IDENTITY = ["name", "_id_domain", "_id_path"]


def url_parts_sql(url: str) -> list[str]:
    """Scheme, lower-case host and path ('/' when empty) of an absolute URL."""
    return [f"lower(regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS _scheme",
            f"lower(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?(\\\\[[^\\\\]]*\\\\]|[^:/?#]*)', 1)) AS _host",
            f"CASE WHEN regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' "
            f"ELSE regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS _path"]


def default_path_sql(path: str) -> str:
    """RFC 6265 default-path: up to the last '/', '/' when none or at 0."""
    return (f"CASE WHEN NOT startswith({path}, '/') OR instr({path}, '/') = 0 THEN '/' "
            f"WHEN length({path}) - length(regexp_replace({path}, '/[^/]*$', '')) = length({path}) THEN '/' "
            f"WHEN regexp_replace({path}, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace({path}, '/[^/]*$', '') END")


def parse_set_cookie(df: DataFrame, line: str = "set_cookie", url: str = "request_url",
                     honor_max_age: bool = False, now: str | None = None) -> DataFrame:
    """K1: ``Set-Cookie`` lines -> jar rows. Unparsable lines (no ``=`` in the
    first pair, empty name) are skipped. Domain's leading dot is removed;
    without Domain the cookie is host-only for the request host; without
    Path it gets the default path. ``Max-Age`` is ignored by the jar unless
    ``honor_max_age`` (then it beats Expires, relative to ``now``)."""
    parts = f"split({line}, ';')"
    d = df.selectExpr("*", f"{parts} AS _parts", *url_parts_sql(url))
    pair = "trim(element_at(_parts, 1))"
    attrs = ("transform(slice(_parts, 2, size(_parts)), _a -> named_struct('k', lower(trim(split_part(_a, '=', 1))), "
             "'v', trim(CASE WHEN instr(_a, '=') > 0 THEN substring(_a, instr(_a, '=') + 1) ELSE '' END)))")
    d = d.selectExpr("*", f"{pair} AS _pair", f"{attrs} AS _attrs")

    def a(k):
        return f"try_element_at(filter(_attrs, _x -> _x.k = {lit(k)}), -1).v"

    def has(k):
        return f"exists(_attrs, _x -> _x.k = {lit(k)})"

    dom = f"nullif(regexp_replace({a('domain')}, '^\\\\.', ''), '')"
    # Cookie dates are GMT ("Wed, 21 Oct 2015 07:28:00 GMT", dashes allowed);
    # the weekday is dropped and the rest parsed in the session zone (UTC).
    core = (f"regexp_extract(replace({a('expires')}, '-', ' '), "
            f"'(\\\\d{{1,2}} [A-Za-z]{{3}} \\\\d{{2,4}} \\\\d{{1,2}}:\\\\d{{2}}:\\\\d{{2}})', 1)")
    exp = f"unix_timestamp(try_to_timestamp(nullif({core}, ''), 'd MMM yyyy H:mm:ss'))"
    if honor_max_age and now is not None:
        exp = f"coalesce(CAST({now} AS BIGINT) + try_cast({a('max-age')} AS BIGINT), {exp})"
    ss = f"CASE lower({a('samesite')}) WHEN 'strict' THEN 'Strict' WHEN 'lax' THEN 'Lax' WHEN 'none' THEN 'None' END"
    out = d.where("instr(_pair, '=') > 0 AND trim(split_part(_pair, '=', 1)) != ''").selectExpr(
        *[c for c in df.columns],
        "trim(split_part(_pair, '=', 1)) AS name", "trim(substring(_pair, instr(_pair, '=') + 1)) AS value",
        f"coalesce({dom}, nullif(_host, '')) AS domain", f"{dom} IS NULL AS host_only",
        f"coalesce(nullif({a('path')}, ''), {default_path_sql('_path')}) AS path",
        f"{exp} AS expires_epoch_s", f"{has('secure')} AS secure", f"{has('httponly')} AS http_only",
        f"{ss} AS same_site")
    return out


def _with_identity(jar: DataFrame) -> DataFrame:
    return jar.selectExpr("*", "coalesce(domain, '') AS _id_domain", "coalesce(path, '/') AS _id_path")


def cookie_jar(observations: DataFrame, order: str = "seq") -> DataFrame:
    """K2: newest observation per identity (name, domain or '', path or '/')."""
    o = _with_identity(observations)
    cols = [c for c in observations.columns]
    packed = "named_struct(" + ", ".join(f"{lit(c)}, `{c}`" for c in cols) + ")"
    g = o.groupBy(*IDENTITY).agg(F.expr(f"max_by({packed}, {order}) AS _row"))
    return g.selectExpr(*[f"_row.`{c}` AS `{c}`" for c in cols])


def prune_expired(jar: DataFrame, now: int | str) -> DataFrame:
    """K3: ``expires_epoch_s <= now`` removed; session cookies (NULL) stay."""
    return jar.where(f"expires_epoch_s IS NULL OR expires_epoch_s > {now}")


def merge_jars(disk: DataFrame, mem: DataFrame) -> DataFrame:
    """K4: the in-memory jar wins by identity, otherwise the union."""
    d = disk.selectExpr("*", "0 AS _prio")
    m = mem.selectExpr("*", "1 AS _prio")
    u = d.unionByName(m)
    cols = disk.columns
    packed = "named_struct(" + ", ".join(f"{lit(c)}, `{c}`" for c in cols) + ")"
    g = _with_identity(u).groupBy(*IDENTITY).agg(F.expr(f"max_by({packed}, _prio) AS _row"))
    return g.selectExpr(*[f"_row.`{c}` AS `{c}`" for c in cols])


def host_suffixes_sql(host: str) -> str:
    """The host and each of its parent domains ('a.b.c' -> a.b.c, b.c, c)."""
    return (f"transform(sequence(1, size(split({host}, '\\\\.'))), "
            f"_i -> array_join(slice(split({host}, '\\\\.'), _i, size(split({host}, '\\\\.'))), '.'))")


def applicable_cookies(urls: DataFrame, jar: DataFrame, now: int | str, url: str = "url") -> DataFrame:
    """K5: (url row, cookie) pairs where the cookie applies to the URL.

    Not expired; secure only on https; host equal to the domain, or a
    dot-suffix match unless host-only; RFC 6265 path match; a cookie
    without a domain never matches.
    """
    u = urls.selectExpr("*", *url_parts_sql(url))
    bare = "regexp_replace(_host, '^\\\\.+', '')"
    u = u.selectExpr("*", f"explode(array_distinct({host_suffixes_sql(bare)})) AS _dom")
    j = jar.where("domain IS NOT NULL").selectExpr(
        *[f"`{c}` AS `c_{c}`" for c in jar.columns], "lower(regexp_replace(domain, '^\\\\.+', '')) AS _dom")
    m = u.join(j, "_dom")
    cp = "coalesce(c_path, '/')"
    cond = (f"(c_expires_epoch_s IS NULL OR c_expires_epoch_s > {now}) "
            f"AND (NOT coalesce(c_secure, false) OR _scheme = 'https') "
            f"AND (NOT coalesce(c_host_only, false) OR regexp_replace(_host, '^\\\\.+', '') = _dom) "
            f"AND ({cp} = _path OR (startswith(_path, {cp}) AND (endswith({cp}, '/') OR substring(_path, length({cp}) + 1, 1) = '/')))")
    return m.where(cond).drop("_dom", "_scheme", "_host", "_path")


def cookie_header(applicable: DataFrame, keys: list[str], order: str = "c_seq") -> DataFrame:
    """K6: ``name=value`` joined by ``; `` in jar order, per URL row."""
    return applicable.groupBy(*keys).agg(F.expr(
        f"array_join(transform(array_sort(collect_list(named_struct('o', {order}, 'nv', concat(c_name, '=', c_value)))), "
        f"_s -> _s.nv), '; ') AS cookie_header"), F.expr("count(*) AS n_cookies"))


def overlay_cookies(explicit: DataFrame, applicable: DataFrame, keys: list[str]) -> DataFrame:
    """K7: an explicit cookie hides every jar cookie of the same name."""
    hidden = explicit.selectExpr(*keys, "name AS c_name")
    kept = applicable.join(hidden, keys + ["c_name"], "left_anti")
    return kept


def validate_cookie_sql(host: str = "_host", path: str = "_path") -> str:
    """K8: reason an explicit cookie is invalid (NULL when valid)."""
    return (f"CASE WHEN name IS NULL OR trim(name) = '' THEN 'empty_name' "
            f"WHEN trim(name) RLIKE '[;=\\\\x00-\\\\x20\\\\x7f]' THEN 'bad_name' "
            f"WHEN coalesce(value, '') RLIKE '[;\\\\r\\\\n]' THEN 'bad_value' "
            f"WHEN coalesce(partitioned, false) AND secure = false THEN 'partitioned_requires_secure' "
            f"WHEN coalesce(same_site, '') = 'None' AND secure = false THEN 'samesite_none_requires_secure' "
            f"WHEN domain IS NOT NULL AND NOT ({host} = lower(regexp_replace(domain, '^\\\\.+', '')) OR endswith({host}, concat('.', lower(regexp_replace(domain, '^\\\\.+', ''))))) "
            f"THEN 'domain_mismatch' "
            f"WHEN cookie_path IS NOT NULL AND NOT startswith({path}, cookie_path) THEN 'path_mismatch' END")


def effective_secure_sql() -> str:
    """K9: secure, or SameSite=None, or partitioned."""
    return "(coalesce(secure, false) OR coalesce(same_site, '') = 'None' OR coalesce(partitioned, false))"


def cookies_redacted(jar: DataFrame, now: int | str) -> DataFrame:
    """Non-expired cookies without their values."""
    return prune_expired(jar, now).drop("value")


def cookies_from_browser(events: DataFrame, json: str = "cookies_json") -> DataFrame:
    """A browser cookie list (JSON array) -> jar rows. Name and value
    required; blank domain/path ignored; expires kept only when > 0 and
    truncated to seconds; host-only when the domain has no leading dot."""
    schema = "array<struct<name:string,value:string,domain:string,path:string,expires:double,secure:boolean,httpOnly:boolean>>"
    c = events.selectExpr("*", f"explode(from_json({json}, '{schema}')) AS _c")
    c = c.where("_c.name IS NOT NULL AND _c.name != '' AND _c.value IS NOT NULL")
    return c.selectExpr(
        *[x for x in events.columns if x != json],
        "_c.name AS name", "_c.value AS value",
        "nullif(regexp_replace(trim(_c.domain), '^\\\\.', ''), '') AS domain",
        "NOT startswith(coalesce(_c.domain, ''), '.') AS host_only",
        "nullif(trim(_c.path), '') AS path",
        "CASE WHEN _c.expires > 0 THEN CAST(_c.expires AS BIGINT) END AS expires_epoch_s",
        "coalesce(_c.secure, false) AS secure", "coalesce(_c.httpOnly, false) AS http_only",
        "CAST(NULL AS STRING) AS same_site")
