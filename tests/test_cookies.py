"""Cookie jar behavior restated from the reference's unit tests."""

from pagefold.operators import cookies as K

JAR = "name string, value string, domain string, host_only boolean, path string, expires_epoch_s long, " \
      "secure boolean, http_only boolean, same_site string, seq long"


def match(spark, jar_rows, url, now=1000):
    jar = spark.createDataFrame(jar_rows, JAR)
    urls = spark.createDataFrame([(1, url)], "id int, url string")
    return sorted(r.c_name for r in K.applicable_cookies(urls, jar, now).collect())


def test_domain_path_secure_expiry(spark):
    base = ("a", "1", "example.com", False, "/", None, False, False, None, 1)
    assert match(spark, [base], "https://deep.www.example.com/") == ["a"]
    assert match(spark, [base], "https://myexample.com/") == []
    host_only = ("h", "1", "example.com", True, "/", None, False, False, None, 1)
    assert match(spark, [host_only], "https://www.example.com/") == []
    assert match(spark, [host_only], "https://example.com/") == ["h"]
    foo = ("p", "1", "example.com", False, "/foo", None, False, False, None, 1)
    assert match(spark, [foo], "https://example.com/foo/bar") == ["p"]
    assert match(spark, [foo], "https://example.com/foobar") == []
    sec = ("s", "1", "example.com", False, "/", None, True, False, None, 1)
    assert match(spark, [sec], "http://example.com/") == [] and match(spark, [sec], "https://example.com/") == ["s"]
    old = ("o", "1", "example.com", False, "/", 1000, False, False, None, 1)
    assert match(spark, [old], "https://example.com/") == []


def test_parse_jar_merge(spark):
    lines = spark.createDataFrame([("a=1; Domain=.example.com; Path=/; Secure; SameSite=Lax", "https://example.com/x/y", 1),
                                   ("b=2", "https://example.com/x/y", 2), ("novalue", "https://example.com/", 3),
                                   ("a=3; Domain=example.com; Path=/", "https://example.com/", 4)],
                                  "set_cookie string, request_url string, seq long")
    parsed = K.parse_set_cookie(lines)
    rows = {(r.name, r.seq): r for r in parsed.collect()}
    assert (rows[("a", 1)].domain, rows[("a", 1)].secure, rows[("a", 1)].same_site) == ("example.com", True, "Lax")
    assert (rows[("b", 2)].domain, rows[("b", 2)].host_only, rows[("b", 2)].path) == ("example.com", True, "/x")
    assert ("novalue", 3) not in rows
    jar = K.cookie_jar(parsed.select("name", "value", "domain", "host_only", "path", "expires_epoch_s", "secure",
                                     "http_only", "same_site", "seq"))
    assert sorted((r.name, r.value) for r in jar.collect()) == [("a", "3"), ("b", "2")]


def test_header_overlay_browser(spark):
    jar = spark.createDataFrame([("a", "1", "example.com", False, "/", None, False, False, None, 1),
                                 ("b", "2", "example.com", False, "/", None, False, False, None, 2)], JAR)
    urls = spark.createDataFrame([(1, "https://example.com/")], "id int, url string")
    ap = K.applicable_cookies(urls, jar, 0)
    assert K.cookie_header(ap, ["id"]).collect()[0].cookie_header == "a=1; b=2"
    explicit = spark.createDataFrame([(1, "a")], "id int, name string")
    assert [r.c_name for r in K.overlay_cookies(explicit, ap, ["id"]).collect()] == ["b"]
    ev = spark.createDataFrame([(1, '[{"name":"x","value":"1","domain":"example.com","path":"/","expires":-1},'
                                   '{"name":"y","value":"2","domain":".example.com","path":"","expires":12.7},{"name":"","value":"z"}]')],
                               "id int, cookies_json string")
    got = sorted((r.name, r.host_only, r.path, r.expires_epoch_s) for r in K.cookies_from_browser(ev).collect())
    assert got == [("x", True, "/", None), ("y", False, None, 12)]


def test_expires_and_max_age(spark):
    lines = spark.createDataFrame([("a=1; Expires=Wed, 21 Oct 2015 07:28:00 GMT; Max-Age=60", "https://example.com/", 1)],
                                  "set_cookie string, request_url string, seq long")
    jar_view = K.parse_set_cookie(lines).collect()[0]
    assert jar_view.expires_epoch_s == 1445412480
    honored = K.parse_set_cookie(lines, honor_max_age=True, now="1000").collect()[0]
    assert honored.expires_epoch_s == 1060
