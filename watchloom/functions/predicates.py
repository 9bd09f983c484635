"""Predicates over fields, Column → Column. A missing field or argument makes a predicate false, never null."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float | bool


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def sure(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def _array(args: tuple[Value, ...]) -> Column:
    return F.array(*(col(a) for a in args))


def _all_present(args: tuple[Value, ...]) -> Column:
    out = F.lit(True)
    for a in args:
        out = out & col(a).isNotNull()
    return out


# arrays and maps -------------------------------------------------------------------------------
def array_contains(field: Column, *elements: Value) -> Column:
    return sure(_all_present(elements) & (F.size(F.array_except(_array(elements), field)) == 0))


def array_contains_any(field: Column, *elements: Value) -> Column:
    return sure(F.arrays_overlap(field, F.array_compact(_array(elements))))


def array_not_contains(field: Column, *elements: Value) -> Column:
    return sure(field.isNotNull() & _all_present(elements) & (F.size(F.array_except(_array(elements), field)) > 0))


def array_not_contains_any(field: Column, *elements: Value) -> Column:
    return sure(field.isNotNull() & _all_present(elements) & ~F.coalesce(F.arrays_overlap(field, _array(elements)), F.lit(False)))


def exists_key_in(field: Column, obj: Column) -> Column:
    return sure(F.map_contains_key(obj, field))


def keys_exist_in_list(obj: Column, names: Column) -> Column:
    return sure((F.size(F.map_keys(obj)) > 0) & (F.size(F.array_except(F.map_keys(obj), names)) == 0))


def match_value(field: Column, values: Column) -> Column:
    return sure(F.array_contains(values, field))


# presence --------------------------------------------------------------------------------------
def exists(field: Column) -> Column:
    return field.isNotNull()


def not_exists(field: Column) -> Column:
    return field.isNull()


# numbers ---------------------------------------------------------------------------------------
_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "greater": lambda a, b: a > b,
    "greater_or_equal": lambda a, b: a >= b,
    "less": lambda a, b: a < b,
    "less_or_equal": lambda a, b: a <= b,
}


def compare(kind: str, op: str) -> Callable[[Column, Value], Column]:
    """A comparison of two fields as int, number (double) or string (by UTF-8 bytes)."""
    target = {"int": "bigint", "number": "double", "string": "string"}[kind]

    def predicate(field: Column, value: Value) -> Column:
        return sure(_COMPARE[op](field.try_cast(target), col(value).try_cast(target)))

    predicate.__name__ = f"{kind}_{op}"
    return predicate


def hex_number(text: Column) -> Column:
    """A hexadecimal text, 0x or not, as a long; null if it isn't one."""
    digits = F.regexp_extract(text, r"^(?:0[xX])?([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, -10).try_cast("bigint"))


def binary_and(field: Column, mask: Value) -> Column:
    return sure(hex_number(field).bitwiseAND(hex_number(col(mask))) != 0)


# text ------------------------------------------------------------------------------------------
def contains(field: Column, text: Value) -> Column:
    return sure(field.contains(col(text)) & (col(text) != ""))


def starts_with(field: Column, text: Value) -> Column:
    return sure(field.startswith(col(text)))


def ends_with(field: Column, text: Value) -> Column:
    return sure(field.endswith(col(text)))


def regex_match(field: Column, pattern: str) -> Column:
    return sure(field.rlike(pattern))


def regex_not_match(field: Column, pattern: str) -> Column:
    return sure(~field.rlike(pattern))


# addresses -------------------------------------------------------------------------------------
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
GROUP = r"[0-9a-fA-F]{1,4}"
IPV6 = rf"^(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,7}}:|(?:{GROUP}:){{1,6}}:{GROUP}|(?:{GROUP}:){{1,5}}(?::{GROUP}){{1,2}}|(?:{GROUP}:){{1,4}}(?::{GROUP}){{1,3}}|(?:{GROUP}:){{1,3}}(?::{GROUP}){{1,4}}|(?:{GROUP}:){{1,2}}(?::{GROUP}){{1,5}}|{GROUP}:(?::{GROUP}){{1,6}}|:(?:(?::{GROUP}){{1,7}}|:)|::(?:[fF]{{4}}:)?{OCTET}(?:\.{OCTET}){{3}})$"
#: Networks that are not public.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "fe80::/10", "fc00::/7", "::1/128")


def is_ipv4(field: Column) -> Column:
    return sure(field.rlike(IPV4))


def is_ipv6(field: Column) -> Column:
    return sure(field.rlike(IPV6))


def ip_number(field: Column) -> Column:
    """An IPv4 address as a long, null if it isn't one."""
    p = F.split(field, r"\.")
    n = [F.get(p, F.lit(k)).try_cast("bigint") for k in range(4)]
    return F.when(is_ipv4(field), n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


def address_hex(ip: Column) -> Column:
    """An IPv4 address as 8 lower-case hexadecimal digits, a full or compressed IPv6 address as 32 (with a dotted end too); null if it is neither."""
    octets = lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda o: F.lpad(F.hex(o.try_cast("bigint")), 2, "0")), "")
    dotted = F.regexp_extract(ip, r":([\d.]+)$", 1)
    end = octets(dotted)
    # a dotted end as two groups
    plain = F.when(dotted.contains("."), F.concat(F.regexp_extract(ip, r"^(.*:)", 1), F.substring(end, 1, 4), F.lit(":"), F.substring(end, 5, 4))).otherwise(ip)
    heads, tails = (F.filter(F.split(F.split_part(plain, F.lit("::"), F.lit(k)), ":"), lambda x: x != "") for k in (1, 2))
    gap = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(heads) - F.size(tails), F.lit(0)))
    groups = F.when(plain.contains("::"), F.concat(heads, gap, tails)).otherwise(F.split(plain, ":"))
    return F.lower(F.when(is_ipv4(ip), octets(ip)).when(is_ipv6(ip), F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), "")))


def ip_key(ip: Column) -> Column:
    """An address as 16 bytes, IPv4 under ::ffff:0:0/96: one order for both."""
    digits = address_hex(ip)
    return F.unhex(F.when(F.length(digits) == 8, F.concat(F.lit("0" * 20 + "ffff"), digits)).otherwise(digits))


def bit_text(digits: Column) -> Column:
    """An address as its bits, 32 or 128 of 0 and 1."""
    return F.array_join(F.transform(F.split(digits, ""), lambda c: F.when(c != "", F.lpad(F.conv(c, 16, 2), 4, "0")).otherwise("")), "")


def _mask_number(mask: Column) -> Column:
    bits = F.regexp_extract(mask, r"^/?(\d{1,2})$", 1).try_cast("int")
    return F.when(bits.between(0, 32), F.lit(4294967296) - F.pow(F.lit(2.0), 32 - bits).cast("bigint")).otherwise(ip_number(mask))


def _once(value: Column, test: Callable[[Column], Column]) -> Column:
    """test(value) with value computed once."""
    return F.transform(F.array(value), test)[0]


def _in_network(network: str) -> Callable[[Column], Column]:
    """Whether an address (a long, or 32 hexadecimal digits) lies in a network that is known here: address/bits."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        return lambda n: n.between(int(net.network_address), int(net.broadcast_address))
    return lambda h: h.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")


def ip_cidr_match(field: Column, subnet: Value, mask: Value) -> Column:
    """Whether an address lies in a subnet of its own kind. mask: a number of bits, with or without /, or a dotted mask."""
    if isinstance(subnet, str) and isinstance(mask, (str, int)):
        try:
            inside, six = _in_network(f"{subnet}/{str(mask).lstrip('/')}"), ":" in subnet
        except ValueError:
            return F.lit(False)
        return sure(_once(address_hex(field), lambda h: (F.length(h) == 32) & inside(h)) if six else _once(ip_number(field), inside))
    net, m = col(subnet), col(mask).cast("string")
    number = _mask_number(m)
    four = ip_number(field).bitwiseAND(number) == ip_number(net).bitwiseAND(number)
    bits = F.regexp_extract(m, r"^/?(\d{1,3})$", 1).try_cast("int")
    ours, theirs = (bit_text(address_hex(x)) for x in (field, net))
    six = bits.between(0, 128) & (F.length(ours) == 128) & (F.substring(ours, F.lit(1), bits) == F.substring(theirs, F.lit(1), bits))
    return sure(F.when(field.contains(":"), six).otherwise(four))


def is_public_ip(field: Column) -> Column:
    four, six = ([_in_network(n) for n in PRIVATE if (":" in n) == kind] for kind in (False, True))
    none = lambda tests: lambda x: ~reduce(or_, (t(x) for t in tests))
    return sure(F.when(field.contains(":"), _once(address_hex(field), none(six))).otherwise(_once(ip_number(field), none(four))))


# types of a variant ----------------------------------------------------------------------------
def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_null(v: Column) -> Column:
    """JSON null: the field is there and holds null."""
    return sure(F.is_variant_null(v))


def is_not_null(v: Column) -> Column:
    """There and not JSON null; an empty object counts as missing."""
    return sure(~F.is_variant_null(v) & (F.to_json(v) != "{}"))


def is_array(v: Column) -> Column:
    return sure(_kind(v).startswith("ARRAY"))


def is_object(v: Column) -> Column:
    return sure(_kind(v).startswith("OBJECT"))


def is_boolean(v: Column) -> Column:
    return sure(_kind(v) == "BOOLEAN")


def is_string(v: Column) -> Column:
    return sure(_kind(v) == "STRING")


def is_number(v: Column) -> Column:
    return sure(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))


def _there_and_not(p: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def predicate(v: Column) -> Column:
        return v.isNotNull() & ~p(v)

    predicate.__name__ = p.__name__.replace("is_", "is_not_", 1)
    return predicate


is_not_array, is_not_object, is_not_boolean, is_not_string, is_not_number = map(_there_and_not, (is_array, is_object, is_boolean, is_string, is_number))

#: The registry users extend: name → function of the field and its arguments.
PREDICATES: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        *(array_contains, array_contains_any, array_not_contains, array_not_contains_any, exists_key_in, keys_exist_in_list, match_value, exists, not_exists, binary_and),
        *(contains, starts_with, ends_with, regex_match, regex_not_match, is_ipv4, is_ipv6, ip_cidr_match, is_public_ip, is_null, is_not_null),
        *(is_array, is_object, is_boolean, is_string, is_number, is_not_array, is_not_object, is_not_boolean, is_not_string, is_not_number),
        *(compare(kind, op) for kind in ("int", "number", "string") for op in _COMPARE),
    )
}
