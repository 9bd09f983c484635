import datetime as dt

import pytest
from pyspark.sql import functions as F

from watchloom.functions import MAPPINGS, PREDICATES, TRANSFORMS
from watchloom.functions import mapping as M
from watchloom.functions import predicates as P
from watchloom.functions import transform as T


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def arr(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


NONE = lambda kind: F.lit(None).cast(kind)


def test_array_predicates(spark):
    a = arr("x", "y")
    got = values(spark, P.array_contains(a, "x", "y"), P.array_contains(a, "x", "z"), P.array_contains_any(a, "z", "y"), P.array_not_contains(a, "x", "z"), P.array_not_contains(a, "x"), P.array_not_contains_any(a, "z"), P.array_not_contains_any(a, "x"), P.array_contains(NONE("array<string>"), "x"), P.array_not_contains_any(NONE("array<string>"), "x"))
    assert got == [True, False, True, True, False, True, False, False, False]


@pytest.mark.parametrize(("op", "want"), [("equal", [False, True, False]), ("not_equal", [True, False, True]), ("greater", [False, False, True]), ("greater_or_equal", [False, True, True]), ("less", [True, False, False]), ("less_or_equal", [True, True, False])])
def test_comparisons(spark, op, want):
    for kind, (a, b, c) in {"int": (1, 2, 3), "number": (1.5, 2.0, 2.5), "string": ("a", "b", "ba")}.items():
        f = PREDICATES[f"{kind}_{op}"]
        assert values(spark, f(F.lit(a), b), f(F.lit(b), b), f(F.lit(c), b)) == want
        assert values(spark, f(NONE("string"), b)) == [False]
    assert values(spark, PREDICATES["int_equal"](F.lit("abc"), 1)) == [False]


def test_text_and_number_predicates(spark):
    s = F.lit("Hello")
    assert values(spark, P.contains(s, "ell"), P.contains(s, ""), P.starts_with(s, "He"), P.ends_with(s, "lo"), P.regex_match(s, "^H.*o$"), P.regex_not_match(s, "^x"), P.regex_not_match(NONE("string"), "^x")) == [True, False, True, True, True, True, False]
    assert values(spark, P.binary_and(F.lit("0x0F"), "0x01"), P.binary_and(F.lit("F0"), "0x0F"), P.binary_and(F.lit("zz"), "0x0F")) == [True, False, False]
    assert values(spark, P.exists(s), P.not_exists(NONE("string")), P.match_value(s, arr("Hello"))) == [True, True, True]


def test_addresses(spark):
    ok4 = [P.is_ipv4(F.lit(x)) for x in ("10.0.0.1", "255.255.255.255", "256.1.1.1", "1.2.3", "::1")]
    assert values(spark, *ok4) == [True, True, False, False, False]
    ok6 = [P.is_ipv6(F.lit(x)) for x in ("::1", "fd00:abcd::1234", "a03:2880:f10c:83:face:b00c::25de", "::ffff:1.2.3.4", "1.2.3.4", ":::")]
    assert values(spark, *ok6) == [True, True, True, True, False, False]
    ip = F.lit("192.168.10.7")
    assert values(spark, P.ip_cidr_match(ip, "192.168.0.0", "16"), P.ip_cidr_match(ip, "192.168.0.0", "255.255.0.0"), P.ip_cidr_match(ip, "192.168.11.0", "24"), P.ip_cidr_match(F.lit("x"), "0.0.0.0", "0")) == [True, True, False, False]
    public = [P.is_public_ip(F.lit(x)) for x in ("8.8.8.8", "10.1.1.1", "172.20.0.1", "127.0.0.1", "fd00::1", "2001:db8::1", "no", "169.254.1.1", "0:0:0:0:0:0:0:1", "::1", "FE80::1", "fec0::1", "::ffff:10.0.0.1")]
    assert values(spark, *public) == [True, False, False, False, False, True, False, True, False, False, False, True, True]
    cases = [("2001:db8::1", "2001:db8::", "32", True), ("2001:db9::1", "2001:db8::", "32", False), ("2001:0DB8:0:0::1", "2001:db8::", "/33", True), ("1.2.3.4", "::", "0", False), ("::ffff:1.2.3.4", "::ffff:102:304", "128", True), ("1.2.3.4", "1.2.3.4", "33", False)]
    assert values(spark, *(P.ip_cidr_match(F.lit(a), b, m) for a, b, m, _ in cases)) == [x for *_, x in cases]
    keys = values(spark, *(F.hex(P.ip_key(F.lit(x))) for x in ("1.2.3.4", "::ffff:1.2.3.4", "2001:db8::1", "x")))
    assert keys == ["00000000000000000000FFFF01020304"] * 2 + ["20010DB8000000000000000000000001", None]


def test_variant_types(spark):
    cases = {'{"a":1}': "object", "[1]": "array", "true": "boolean", "1": "number", "1.5": "number", '"x"': "string", "null": "null", "{}": "object"}
    for text, kind in cases.items():
        v = F.parse_json(F.lit(text))
        got = values(spark, *(getattr(P, f"is_{k}")(v) for k in ("object", "array", "boolean", "number", "string", "null")))
        assert got == [kind == k for k in ("object", "array", "boolean", "number", "string", "null")], text
        assert values(spark, P.is_not_null(v)) == [text not in ("null", "{}")]
    assert values(spark, P.is_not_array(F.parse_json(F.lit("1"))), P.is_not_array(NONE("variant"))) == [True, False]


def test_mapping_text_and_numbers(spark):
    assert values(spark, M.concat("a", 1, F.lit(True)), M.concat("a", NONE("string")), M.concat_any("a", NONE("string"), 2)) == ["a1true", None, "a2"]
    assert values(spark, M.decode_base16(F.lit("48656C6C6F")), M.decode_base16(F.lit("4")), M.hex_to_number(F.lit("0x1F")), M.hex_to_number(F.lit("g"))) == ["Hello", None, 31, None]
    assert values(spark, M.decode_base16(F.lit("ff")), M.decode_base16(F.lit("c3a9"))) == [None, "é"]
    assert values(spark, M.int_calculate("sum", 1, 2, 3), M.int_calculate("sub", 10, 3), M.int_calculate("mul", 1 << 62, 4), M.int_calculate("div", -7, 2), M.int_calculate("div", 7, 0)) == [6, 7, None, -3, None]
    assert values(spark, M.float_calculate("div", 1.0, 4), M.float_calculate("div", 1.0, 0), M.float_calculate("mul", 1e308, 10)) == [0.25, None, None]
    assert values(spark, M.to_int(F.lit(9.6)), M.to_int(F.lit(9.6), "round"), M.to_int(F.lit(-9.6)), M.to_bool(F.lit(0)), M.regex_extract(F.lit("id=42"), r"id=(\d+)"), M.regex_extract(F.lit("x"), r"(\d)")) == [9, 10, -9, False, "42", None]
    assert values(spark, M.join(arr("a", "b"), "-"), M.to_string(F.lit(5))) == ["a-b", "5"]


def test_mapping_dates(spark):
    assert values(spark, M.date_from_epoch(F.lit(1700000000)), M.date_to_epoch(F.lit("2023-11-14T22:13:20Z")), M.date_to_epoch(F.lit("no"))) == ["2023-11-14T22:13:20Z", 1700000000.0, None]
    assert values(spark, *(M.date_from_epoch(F.lit(x)) for x in (9223372036854775807, -9223372036854775808, 253402300799, 253402300800, "x"))) == [None, None, "9999-12-31T23:59:59Z", None, None]
    assert abs(values(spark, M.system_epoch())[0] - dt.datetime.now().timestamp()) < 60


def test_network(spark):
    assert values(spark, M.iana_protocol_number_to_name(F.lit("6")), M.iana_protocol_number_to_name(F.lit(200)), M.iana_protocol_name_to_number(F.lit("TCP")), M.iana_protocol_name_to_number(F.lit("icmp6"))) == ["tcp", None, "6", "58"]
    assert values(spark, *(M.iana_protocol_number_to_name(F.lit(k)) for k in (58, 147, 61, 148, 253, -1)), M.iana_protocol_number_to_name(F.lit("6.0"))) == ["ipv6-icmp", "bit-emu", None, None, None, None, None]
    assert values(spark, *(M.iana_protocol_name_to_number(F.lit(k)) for k in ("UDP", "udp_lite", "ip-in-ip", "ICMPv6", "smtp", ""))) == ["17", "136", "94", "58", None, None]
    assert [M.PROTOCOLS[k] for k in (17, 41, 88, 112, 132, 136, 142)] == ["udp", "ipv6", "eigrp", "vrrp", "sctp", "udplite", "ethernet"]
    assert values(spark, M.ip_version(F.lit("1.2.3.4")), M.ip_version(F.lit("::1")), M.ip_version(F.lit("x"))) == ["IPv4", "IPv6", None]
    # published examples of Community ID version 1
    one = M.network_community_id(F.lit("128.232.110.120"), F.lit("66.35.250.204"), F.lit(34855), F.lit(80), F.lit(6))
    turned = M.network_community_id(F.lit("66.35.250.204"), F.lit("128.232.110.120"), F.lit(80), F.lit(34855), F.lit(6))
    assert values(spark, one, turned) == ["1:LQU9qZlK+B5F3KDmev6m5PMibrg="] * 2
    a, b, six = F.lit("10.0.0.1"), F.lit("10.0.0.2"), F.lit("2001:db8::1")
    odd = ((a, b, 70000, 1, 6), (a, b, -1, 1, 6), (a, b, 1, 1, 600), (a, six, 1, 1, 6), (a, F.lit("x"), 1, 1, 6), (a, b, None, 1, 6))
    assert values(spark, *(M.network_community_id(x, y, *(F.lit(n) for n in rest)) for x, y, *rest in odd)) == [None] * 6


def test_syslog_and_objects(spark):
    assert values(spark, M.syslog_extract_facility(F.lit(191))["name"], M.syslog_extract_severity(F.lit(13))["name"], M.syslog_extract_facility(F.lit(192))) == ["local7", "notice", None]
    objects = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(o).alias("o")) for k, v, o in (("Some Key", "1", ""), ("b", "2", "x"), ("some key", "3", "y"))))
    assert values(spark, M.array_obj_to_map_kv(objects, "k", "v")) == [{"b": "2", "some_key": "3"}]
    assert values(spark, M.array_extract_key_obj(objects, "k", "v", "o"))[0]["b"].old == "x"


def test_transforms(spark):
    none = NONE("array<string>")
    assert values(spark, T.array_append(none, "a"), T.array_append(arr("x"), "a", NONE("string")), T.array_append_any(arr("x"), "a", NONE("string")), T.array_append_unique(arr("x"), "x", "y"), T.array_append_unique_any(none, NONE("string"), "y", "y")) == [["a"], None, ["x", "a"], ["x", "y"], ["y"]]
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    n = F.create_map(F.lit("b"), F.lit("3"), F.lit("C c"), F.lit("4"))
    assert values(spark, T.merge(m, n), T.delete_key(m, "a"), T.delete_fields_with_value(m, "2"), T.erase_custom_fields(m, ["a"]), T.get_key_in(m, "z")) == [{"a": "1", "b": "3", "C c": "4"}, {"b": "2"}, {"a": "1"}, {"a": "1"}, None]
    assert values(spark, T.merge_arrays(arr("1", "3"), arr("0", "1", "2", "4")), T.sanitize_fields(n), T.merge_key_in(m, F.create_map(F.lit("k"), n), "k")) == [["1", "3", "0", "2", "4"], {"b": "3", "c_c": "4"}, {"a": "1", "b": "3", "C c": "4"}]
    deep, other = F.create_map(F.lit("x"), m), F.create_map(F.lit("x"), n, F.lit("y"), m)
    assert values(spark, T.merge_recursive(deep, other))[0] == {"x": {"a": "1", "b": "3", "C c": "4"}, "y": {"a": "1", "b": "2"}}
    assert values(spark, T.replace(F.lit("a.b.c"), ".", "-"), T.split(arr("z"), F.lit("a|b"), "|"), T.trim(F.lit("--x-"), "begin", "-"), T.trim(F.lit("--x-"), "end", "-"), T.trim(F.lit("--x-"), "both", "-")) == ["a-b-c", ["z", "a", "b"], "x-", "--x", "x"]
    df = T.rename(spark.createDataFrame([(1, 2)], "old int, new int"), "old", "new")
    assert df.columns == ["new"] and df.first()[0] == 1


def test_registries():
    assert len(PREDICATES) >= 49 and len(MAPPINGS) >= 26 and len(TRANSFORMS) >= 18
