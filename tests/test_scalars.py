import base64
import datetime
import hashlib
import ipaddress
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pulseyard import functions as fn
from pulseyard.functions.network import IPV4_NON_PUBLIC, URL_PATTERN


def column(spark, values, kind, make):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", make(F.col("v")).alias("r"))
    return [r.r for r in df.orderBy("i").collect()]


SECONDS = [0, 1, 59, 60, 3599, 3600, 86399, 86400, 86401, 172799, 172800, 2147483647, 10**10]


def test_format_duration_equals_timedelta(spark):
    expected = [str(datetime.timedelta(seconds=s)) for s in SECONDS]
    assert column(spark, SECONDS, "bigint", fn.format_duration) == expected


def test_uptime_clock_wraps_at_a_day(spark):
    expected = [time.strftime("%H:%M:%S", time.gmtime(s)) for s in SECONDS]
    assert column(spark, SECONDS, "bigint", fn.uptime_clock) == expected


def test_percent_rounds_halves_to_even(spark):
    pairs = [(n, t) for t in (0, 1, 3, 7, 8, 40, 200) for n in range(0, 45)]
    df = spark.createDataFrame(pairs, "n bigint, t bigint")
    for r in df.select("n", "t", fn.percent_half_even(F.col("n"), F.col("t")).alias("p")).collect():
        assert r.p == round((r.n / max(r.t, 1)) * 100), r


def test_ceil_div_and_mask(spark):
    values = [-100, -1, 0, 1, 29, 30, 31, 65535, 65536, 70000]
    assert column(spark, values, "bigint", lambda c: fn.ceil_div(c, F.lit(30))) == [math.ceil(v / 30) for v in values]
    assert column(spark, values, "bigint", fn.mask16) == [v & 0xFFFF for v in values]


def test_time_ago_labels(spark):
    cases = {
        0: "just now", 9: "just now", 10: "10 seconds ago", 59: "59 seconds ago", 60: "1 minute ago",
        119: "1 minute ago", 120: "2 minutes ago", 3600: "1 hour ago", 86400: "1 day ago",
        6 * 86400: "6 days ago", 7 * 86400: "1 week ago", 30 * 86400: "4 weeks ago",
        31 * 86400: "1 month ago", 364 * 86400: "11 months ago", 366 * 86400: "1 year ago",
        900 * 86400: "2 years ago",
    }
    ages = list(cases)
    labels = column(spark, ages, "bigint", lambda c: fn.time_ago(F.lit(10**9) - c, F.lit(10**9)))
    assert labels == [cases[a] for a in ages]


def test_text_helpers(spark):
    names = ["^1Red^:x", "^12", "a^b", "^^5", "no"]
    assert column(spark, names, "string", fn.strip_color_codes) == [re.sub(r"\^([0-9]+|:)", "", n) for n in names]
    swap = column(spark, ["ab12", "$1"], "string", lambda c: fn.regex_replace(c, r"([a-z]+)(\d+)", r"\2$\1"))
    assert swap == ["12$ab", "$1"]
    cents = [0, 5, 99, 100, 123456, -250]
    assert column(spark, cents, "bigint", fn.cents_to_text) == [f"{c / 100.0:.2f}" for c in cents]
    assert column(spark, ["0.00", "1.50"], "string", lambda c: fn.price_label(c, F.lit("month"))) == ["Free", "$1.50 per month"]
    assert column(spark, ["a.dll", "B.JS", "c.txt", None], "string", fn.content_type) == [0, 1, None, None]
    assert column(spark, [None, 3], "bigint", fn.count_or_zero) == [0, 3]
    assert column(spark, [7], "int", lambda c: fn.occupancy_label(c, F.lit(18))) == ["7/18"]
    assert column(spark, [28960], "int", lambda c: fn.connect_string(F.lit("1.2.3.4"), c)) == ["connect 1.2.3.4:28960"]


def test_base64_is_one_line(spark):
    data = [bytearray(range(256)) * 3, bytearray()]
    assert column(spark, data, "binary", fn.base64_encode) == [base64.b64encode(bytes(d)).decode() for d in data]


def python_non_public(text):
    if "%" in text:  # an address with a zone is not accepted
        return None
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return None
    if ip.version == 4:
        return any(ip in ipaddress.ip_network(c) for c in IPV4_NON_PUBLIC)
    reserved = ("fc00::/7", "fe80::/10", "fec0::/10", "::1/128")
    return any(ip in ipaddress.ip_network(c) for c in reserved)


def test_is_non_public_equals_ipaddress(spark):
    rng = random.Random(7)
    ips = [
        "10.0.0.4", "9.255.255.255", "11.0.0.0", "100.63.255.255", "100.64.0.0", "127.0.0.1", "169.254.1.1",
        "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.0", "192.0.0.1", "192.0.1.0", "192.168.1.1",
        "198.17.0.0", "198.18.0.1", "198.20.0.0", "239.1.1.1", "8.8.8.8", "255.255.255.255", "0.0.0.0",
        "256.1.1.1", "1.2.3", "1.2.3.4.5", "x", "", " 10.0.0.1", "10.0.0.1\n",
        "::1", "::", "0:0:0:0:0:0:0:1", "fc00::", "fdff::1", "fe00::1", "fe80::1", "febf::", "fec0::1", "feff::1",
        "ff00::1", "2001:db8::1", "FD00::A", "::ffff:10.0.0.1", "::10.0.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::",
        "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", ":::", ":1", "1:", "fe80::1%eth0", "1:2:3:4:5:6:1.2.3.4",
        "1:2:3:4:5:6:7:1.2.3.4", "g::1",
    ]
    ips += [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(300)]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    ips += [str(ipaddress.IPv6Address((rng.choice([0xFC, 0xFD, 0xFE]) << 120) | rng.getrandbits(120))) for _ in range(200)]
    got = column(spark, ips, "string", fn.is_non_public)
    assert {ip: g for ip, g in zip(ips, got)} == {ip: python_non_public(ip) for ip in ips}
    kinds = column(spark, ips, "string", fn.ip_version)
    for ip, kind in zip(ips, kinds):
        assert (kind is None) == (python_non_public(ip) is None), ip


URLS = {
    None: "http://203.0.113.9:1624",
    "http://127.0.0.1:1624": "http://203.0.113.9:1624",
    "https://10.0.0.4:80/a?b": "http://203.0.113.9:80/a?b",
    "http://localhost:1624": "http://localhost:1624",
    "HTTP://Example.COM/x": "HTTP://Example.COM/x",
    "ftp://x.com": None,
    "http://a.com b": None,
    "https://1.2.3.4.5/": None,
    "": None,
    "http://999.1.1.1:5": "http://999.1.1.1:5",
    "http://8.8.8.8": "http://8.8.8.8",
}


def test_normalize_webfront(spark):
    got = column(spark, list(URLS), "string", lambda c: fn.normalize_webfront(c, F.lit("203.0.113.9")))
    assert got == list(URLS.values())


def test_url_parts_equal_python_groups(spark):
    urls = [u for u in URLS if u is not None] + ["http://a-b.co.uk:80?x=1", "https://x.museum./p", "http://-a.com"]
    pattern = re.compile(URL_PATTERN.removeprefix("(?i)"), re.IGNORECASE)
    for url, got in zip(urls, column(spark, urls, "string", fn.url_parts)):
        match = pattern.match(url)
        assert (tuple(got) if got else None) == (match.groups() if match else None), url


def test_keys_equal_hashlib(spark):
    pairs = [("a@x", "i1"), ("a@x", "i1"), ("é", "ß"), (None, "i"), ("a", None)]
    df = spark.createDataFrame(pairs, "s string, t string").repartition(1)
    keys = {(r.s, r.t): r.k for r in df.withColumn("k", fn.derive_key("s", "t")).collect()}
    for (seed, salt), key in keys.items():
        if seed is None or salt is None:
            assert key is None
        else:
            assert bytes(key) == hashlib.pbkdf2_hmac("sha512", seed.encode(), salt.encode(), 10000, 32)


@pytest.mark.parametrize("payload", [b"hello", b"", bytes(1000)])
def test_sealed_content_opens_again(spark, payload):
    key = hashlib.sha256(b"k").digest()
    df = spark.createDataFrame([(bytearray(payload), bytearray(key))] * 4, "p binary, k binary")
    sealed = df.withColumn("s", fn.seal_content(F.col("p"), F.col("k")))
    moved = F.concat(F.expr("substring(s, -12, 12)"), F.expr("substring(s, 1, length(s) - 12)"))
    rows = sealed.select("s", F.aes_decrypt(moved, F.col("k"), F.lit("GCM")).alias("o")).collect()
    assert all(bytes(r.o) == payload and len(r.s) == len(payload) + 28 for r in rows)
    assert len({bytes(r.s)[-12:] for r in rows}) == 4


def test_sql_functions_equal_columns(spark):
    fn.register_sql_functions(spark)
    for s in (0, 59, 86399, 86400, 90061, 200000):
        row = spark.sql(f"SELECT format_duration({s}) d, uptime_clock({s}) c, ceil_div({s}, 7) e, mask16({s}) m").first()
        assert row.d == str(datetime.timedelta(seconds=s)) and row.c == time.strftime("%H:%M:%S", time.gmtime(s))
        assert (row.e, row.m) == (math.ceil(s / 7), s & 0xFFFF)
    row = spark.sql(
        """SELECT strip_color_codes('^1a^:') a, content_type('X.DLL') b, price_label('0.00', 'y') c,
                  cents_to_text(150) d, percent_half_even(1, 8) e, count_or_zero(NULL) f,
                  occupancy_label(1, 2) g, connect_string('h', 5) h"""
    ).first()
    assert tuple(row) == ("a", 0, "Free", "1.50", 12, 0, "1/2", "connect h:5")


def test_ceil_div_is_exact(spark):
    big = 2**53 + 1
    cases = [(7, 3), (-7, 3), (6, 3), (0, 5), (big, 1), (-big, 2), (7, -3), (-7, -3)]
    rows = spark.createDataFrame(cases, "a bigint, b bigint")
    fn.register_sql_functions(spark, "t_")
    rows.createOrReplaceTempView("t_cases")
    wanted = [-(-a // b) for a, b in cases]
    assert [r.n for r in rows.select(fn.ceil_div(F.col("a"), F.col("b")).alias("n")).collect()] == wanted
    assert [r.n for r in spark.sql("SELECT t_ceil_div(a, b) AS n FROM t_cases").collect()] == wanted


def test_sql_replace_equals_the_column(spark):
    fn.register_sql_functions(spark, "t_")
    row = spark.createDataFrame([("ab $x",)], "s string")
    row.createOrReplaceTempView("t_texts")
    for find, put in (("(a)(b)", r"\\2\\1"), ("x", "$1"), ("b", "")):
        sql = spark.sql("SELECT t_regex_replace(s, :find, :put) AS x FROM t_texts", args={"find": find, "put": put}).first().x
        assert sql == row.select(fn.regex_replace(F.col("s"), find, put).alias("x")).first().x
