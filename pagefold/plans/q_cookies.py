"""Queries for the cookie operators (K2-K10) over the cookie_obs adapter."""

from __future__ import annotations

from pagefold.operators import cookies as K
from pagefold.plans.sqlutil import select_items
from pagefold.plans.registry import register

NOW = 1000
# --- fixed values: cookie_obs adapter (FIXTURES 2.4) -------------------------
PATHS = ["/", "/en", "/en/", "/fr"]
EXPLICIT_NAMES = ["c1", "c3"]
# --- end fixed values -------------------------------------------------------

HOST_S = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
LAST2_S = f"array_join(slice(split({HOST_S}, '\\\\.'), -2, 2), '.')"
HOST_D = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
LAST2_D = f"array_to_string(string_split({HOST_D}, '.')[-2:], '.')"


def cookie_obs_select(host: str, last2: str, string: str) -> str:
    path = "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATHS)) + " END"
    return (f"concat('c', CAST(page_id % 7 AS {string})) AS name, concat('v', CAST(page_id AS {string})) AS value, "
            f"CASE WHEN page_id % 3 = 0 THEN {host} ELSE {last2} END AS domain, page_id % 3 = 0 AS host_only, "
            f"{path} AS path, CASE page_id % 6 WHEN 0 THEN 500 WHEN 1 THEN 1000 WHEN 2 THEN 2000 END AS expires_epoch_s, "
            f"page_id % 5 = 0 AS secure, false AS http_only, CAST(NULL AS {string}) AS same_site, page_id AS seq")


def obs(t):
    return t("pages").selectExpr(*select_items(cookie_obs_select(HOST_S, LAST2_S, "STRING")))


OBS_D = f"obs AS (SELECT {cookie_obs_select(HOST_D, LAST2_D, 'VARCHAR')} FROM pages)"
JAR_D = f"""{OBS_D},
jar AS (SELECT name, arg_max(value, seq) AS value, arg_max(domain, seq) AS domain, arg_max(host_only, seq) AS host_only,
  arg_max(path, seq) AS path, arg_max_null(expires_epoch_s, seq) AS expires_epoch_s, arg_max(secure, seq) AS secure,
  arg_max(http_only, seq) AS http_only, arg_max_null(same_site, seq) AS same_site, max(seq) AS seq
  FROM obs GROUP BY name, coalesce(domain, ''), coalesce(path, '/'))"""
JAR_COLS = "name, value, domain, host_only, path, expires_epoch_s, secure, http_only, same_site, seq"


def jar(t):
    return K.cookie_jar(obs(t))


@register("k2_cookie_jar", f"WITH {JAR_D}\nSELECT {JAR_COLS} FROM jar")
def k2(t):
    """Newest observation per cookie identity."""
    return jar(t)


@register("k3_prune_expired", f"WITH {JAR_D}\nSELECT {JAR_COLS} FROM jar WHERE expires_epoch_s IS NULL OR expires_epoch_s > {NOW}")
def k3(t):
    """Jar without expired cookies (expiry <= now)."""
    return K.prune_expired(jar(t), NOW)


@register("k4_merge_jars", f"""WITH {OBS_D},
_u AS (SELECT *, 0 AS _prio FROM obs WHERE seq % 2 = 0 UNION ALL SELECT *, 1 FROM obs WHERE seq % 2 = 1),
_w AS (SELECT *, row_number() OVER (PARTITION BY name, coalesce(domain, ''), coalesce(path, '/') ORDER BY _prio DESC, seq DESC) AS _rn FROM _u)
SELECT {JAR_COLS} FROM _w WHERE _rn = 1""")
def k4(t):
    """Merge of two jars (odd observations in memory win over even on disk)."""
    o = obs(t)
    disk = K.cookie_jar(o.where("seq % 2 = 0"))
    mem = K.cookie_jar(o.where("seq % 2 = 1"))
    return K.merge_jars(disk, mem)


APPLIC_D = f"""{JAR_D},
_u AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS _scheme,
  lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?(\\[[^\\]]*\\]|[^:/?#]*)', 1)) AS _host,
  coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS _path FROM pages),
ap AS (SELECT _u.page_id, _u.url, jar.name AS c_name, jar.value AS c_value, jar.seq AS c_seq FROM _u JOIN jar
  ON jar.domain IS NOT NULL AND (jar.expires_epoch_s IS NULL OR jar.expires_epoch_s > {NOW})
  AND (NOT jar.secure OR _scheme = 'https')
  AND (lower(jar.domain) = _host OR (NOT jar.host_only AND ends_with(_host, '.' || lower(jar.domain))))
  AND (jar.path = _path OR (starts_with(_path, jar.path) AND (ends_with(jar.path, '/') OR substr(_path, length(jar.path) + 1, 1) = '/'))))"""


def applicable(t):
    return K.applicable_cookies(t("pages").select("page_id", "url"), jar(t), NOW)


@register("k5_applicable_cookies", f"WITH {APPLIC_D}\nSELECT page_id, c_name, c_value, c_seq FROM ap")
def k5(t):
    """(page url, cookie) pairs by domain, host-only, path, secure and expiry."""
    return applicable(t).select("page_id", "c_name", "c_value", "c_seq")


@register("k6_cookie_header", f"""WITH {APPLIC_D}
SELECT page_id, string_agg(c_name || '=' || c_value, '; ' ORDER BY c_seq) AS cookie_header, count(*) AS n_cookies FROM ap GROUP BY page_id""")
def k6(t):
    """Cookie header per page URL, in jar order."""
    return K.cookie_header(applicable(t), ["page_id"])


EXPL = ", ".join(f"'{n}'" for n in EXPLICIT_NAMES)


@register("k7_overlay_cookies", f"""WITH {APPLIC_D}
SELECT page_id, c_name, c_value, c_seq FROM ap WHERE c_name NOT IN ({EXPL})
UNION ALL SELECT page_id, n, 'explicit', -1 FROM pages, (VALUES {', '.join(f"('{n}')" for n in EXPLICIT_NAMES)}) e(n)""")
def k7(t):
    """Explicit cookies c1, c3 hide jar cookies of the same name."""
    from pagefold.functions.core import lit
    names = ", ".join(lit(n) for n in EXPLICIT_NAMES)
    explicit = t("pages").selectExpr("page_id", f"explode(array({names})) AS name")
    kept = K.overlay_cookies(explicit, applicable(t), ["page_id"]).select("page_id", "c_name", "c_value", "c_seq")
    ex = explicit.selectExpr("page_id", "name AS c_name", "'explicit' AS c_value", "CAST(-1 AS BIGINT) AS c_seq")
    return kept.unionByName(ex)


@register("k10_cookies_redacted", f"""WITH {JAR_D}
SELECT name, domain, host_only, path, expires_epoch_s, secure, http_only, same_site, seq FROM jar
WHERE expires_epoch_s IS NULL OR expires_epoch_s > {NOW}""")
def k10(t):
    """Non-expired jar cookies without values."""
    return K.cookies_redacted(jar(t), NOW)
