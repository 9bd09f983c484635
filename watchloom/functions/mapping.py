"""Functions that compute a field's value. A missing or unfit input gives null, so coalesce(new, old) keeps the old value."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import Value, address_hex, col, hex_number, is_ipv4, is_ipv6

# text ------------------------------------------------------------------------------------------


def concat(*parts: Value) -> Column:
    return F.concat(*(col(p).cast("string") for p in parts))


def concat_any(*parts: Value) -> Column:
    return F.concat_ws("", *(col(p).cast("string") for p in parts))


def downcase(x: Column) -> Column:
    return F.lower(x)


def upcase(x: Column) -> Column:
    return F.upper(x)


def join(array: Column, separator: str) -> Column:
    return F.array_join(array, separator)


def decode_base16(x: Column) -> Column:
    """The text of hexadecimal digits; null if they aren't, or aren't UTF-8."""
    return F.try_validate_utf8(F.when(x.rlike("^(?:[0-9a-fA-F]{2})+$"), F.unhex(x)).cast("string"))


def hex_to_number(x: Column) -> Column:
    return hex_number(x)


def regex_extract(x: Column, pattern: str) -> Column:
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


def sha1(x: Column) -> Column:
    return F.sha1(x)


def to_string(x: Column) -> Column:
    return x.cast("string")


# numbers ---------------------------------------------------------------------------------------
def int_calculate(op: str, *operands: Value) -> Column:
    """Left fold of + - * / over integers; overflow and division by zero give null."""
    step = {"sum": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply, "div": lambda a, b: F.when(b != 0, F.try_divide(F.try_subtract(a, F.try_mod(a, b)), b)).try_cast("bigint")}[op]
    return reduce(step, (col(x).try_cast("bigint") for x in operands))


def float_calculate(op: str, *operands: Value) -> Column:
    """Left fold over doubles; division by zero or an infinite result gives null."""
    step: Callable[[Column, Column], Column] = {"sum": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide}[op]
    out = reduce(step, (col(x).try_cast("double") for x in operands))
    return F.when(F.abs(out) < float("inf"), out)


def to_bool(x: Column) -> Column:
    return x != 0


def to_int(x: Column, mode: str = "truncate") -> Column:
    return (F.round(x) if mode == "round" else x).try_cast("bigint")


# dates -----------------------------------------------------------------------------------------
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def epoch_timestamp(seconds: Column) -> Column:
    """Seconds since 1970 as a timestamp; null outside the years 1 to 9999."""
    s = seconds.try_cast("bigint")
    return F.timestamp_seconds(F.when(s.between(-62135596800, 253402300799), s))


def date_from_epoch(seconds: Column) -> Column:
    return F.date_format(epoch_timestamp(seconds), ISO)


def date_to_epoch(text: Column, fmt: str = ISO) -> Column:
    return F.unix_micros(F.try_to_timestamp(text, F.lit(fmt))) / 1e6


def get_date() -> Column:
    return F.date_format(F.current_timestamp(), ISO)


def system_epoch() -> Column:
    return F.unix_timestamp()


# network ---------------------------------------------------------------------------------------
#: Keywords of the public protocol registry by number.
# fmt: off
PROTOCOLS = {
    0: "hopopt", 1: "icmp", 2: "igmp", 3: "ggp", 4: "ipv4", 5: "st", 6: "tcp", 7: "cbt",
    8: "egp", 9: "igp", 10: "bbn-rcc-mon", 11: "nvp-ii", 12: "pup", 13: "argus", 14: "emcon", 15: "xnet",
    16: "chaos", 17: "udp", 18: "mux", 19: "dcn-meas", 20: "hmp", 21: "prm", 22: "xns-idp", 23: "trunk-1",
    24: "trunk-2", 25: "leaf-1", 26: "leaf-2", 27: "rdp", 28: "irtp", 29: "iso-tp4", 30: "netblt", 31: "mfe-nsp",
    32: "merit-inp", 33: "dccp", 34: "3pc", 35: "idpr", 36: "xtp", 37: "ddp", 38: "idpr-cmtp", 39: "tp++",
    40: "il", 41: "ipv6", 42: "sdrp", 43: "ipv6-route", 44: "ipv6-frag", 45: "idrp", 46: "rsvp", 47: "gre",
    48: "dsr", 49: "bna", 50: "esp", 51: "ah", 52: "i-nlsp", 53: "swipe", 54: "narp", 55: "mobile",
    56: "tlsp", 57: "skip", 58: "ipv6-icmp", 59: "ipv6-nonxt", 60: "ipv6-opts", 62: "cftp", 64: "sat-expak", 65: "kryptolan",
    66: "rvd", 67: "ippc", 69: "sat-mon", 70: "visa", 71: "ipcv", 72: "cpnx", 73: "cphb", 74: "wsn",
    75: "pvp", 76: "br-sat-mon", 77: "sun-nd", 78: "wb-mon", 79: "wb-expak", 80: "iso-ip", 81: "vmtp", 82: "secure-vmtp",
    83: "vines", 84: "ttp", 85: "nsfnet-igp", 86: "dgp", 87: "tcf", 88: "eigrp", 89: "ospfigp", 90: "sprite-rpc",
    91: "larp", 92: "mtp", 93: "ax.25", 94: "ipip", 95: "micp", 96: "scc-sp", 97: "etherip", 98: "encap",
    100: "gmtp", 101: "ifmp", 102: "pnni", 103: "pim", 104: "aris", 105: "scps", 106: "qnx", 107: "a/n",
    108: "ipcomp", 109: "snp", 110: "compaq-peer", 111: "ipx-in-ip", 112: "vrrp", 113: "pgm", 115: "l2tp", 116: "ddx",
    117: "iatp", 118: "stp", 119: "srp", 120: "uti", 121: "smp", 122: "sm", 123: "ptp", 124: "isis-over-ipv4",
    125: "fire", 126: "crtp", 127: "crudp", 128: "sscopmce", 129: "iplt", 130: "sps", 131: "pipe", 132: "sctp",
    133: "fc", 134: "rsvp-e2e-ignore", 135: "mobility-header", 136: "udplite", 137: "mpls-in-ip", 138: "manet", 139: "shim6", 140: "wesp",
    141: "rohc", 142: "ethernet", 143: "aggfrag", 144: "nsh", 145: "homa", 147: "bit-emu",
}
# fmt: on
ALIASES = {"icmp6": "ipv6-icmp", "icmpv6": "ipv6-icmp", "ospf": "ospfigp", "udp-lite": "udplite", "ip-in-ip": "ipip"}


def _lookup(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def iana_protocol_number_to_name(code: Column) -> Column:
    return F.try_element_at(_lookup(PROTOCOLS), code.try_cast("int"))


def iana_protocol_name_to_number(name: Column) -> Column:
    plain = F.lower(F.translate(F.trim(name), "_ ", "--"))
    plain = F.coalesce(F.try_element_at(_lookup(ALIASES), plain), plain)
    return F.try_element_at(_lookup({v: str(k) for k, v in PROTOCOLS.items()}), plain)


def ip_version(ip: Column) -> Column:
    return F.when(is_ipv4(ip), "IPv4").when(is_ipv6(ip), "IPv6")


#: ICMP and ICMPv6 types that answer each other; a flow of these has the two types as its ports.
ICMP_PAIRS = {1: {8: 0, 0: 8, 13: 14, 14: 13, 15: 16, 16: 15, 17: 18, 18: 17, 10: 9, 9: 10}, 58: {128: 129, 129: 128, 133: 134, 134: 133, 135: 136, 136: 135, 130: 131, 131: 130, 144: 145, 145: 144, 139: 140, 140: 139}}


def network_community_id(src: Column, dst: Column, sport: Column, dport: Column, protocol: Column, seed: int = 0) -> Column:
    """Community ID version 1: 1: and the base64 SHA-1 of seed, ordered endpoints, protocol and ports.

    Null for ports outside 0..65535, protocols outside 0..255, and for addresses that aren't both of one kind.
    """
    proto, a, b = protocol.try_cast("int"), sport.try_cast("int"), dport.try_cast("int")
    answer = F.lit(None).cast("int")
    for number, pairs in ICMP_PAIRS.items():
        answer = F.when(proto == number, F.try_element_at(_lookup(pairs), a)).otherwise(answer)
    icmp = proto.isin(*ICMP_PAIRS)
    one_way = icmp & answer.isNull()
    b = F.when(icmp & answer.isNotNull(), answer).otherwise(b)
    ha, hb = address_hex(src), address_hex(dst)

    def two(x: Column) -> Column:
        return F.lower(F.lpad(F.hex(x.cast("bigint")), 4, "0"))

    ordered = one_way | (ha < hb) | ((ha == hb) & (a <= b))
    left = F.concat(F.when(ordered, F.concat(ha, hb)).otherwise(F.concat(hb, ha)))
    ports = F.when(ordered, F.concat(two(a), two(b))).otherwise(F.concat(two(b), two(a)))
    fits = proto.between(0, 255) & a.between(0, 65535) & b.between(0, 65535) & (F.length(ha) == F.length(hb))
    text = F.concat(F.lit(f"{seed:04x}"), left, F.lpad(F.hex(proto.cast("bigint")), 2, "0"), F.lit("00"), ports)
    return F.when(fits, F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(F.unhex(text))))))


# syslog ----------------------------------------------------------------------------------------
#: Names by code.
FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")


def _coded(code: Column, names: tuple[str, ...]) -> Column:
    return F.struct(code.alias("code"), F.element_at(F.array(*(F.lit(n) for n in names)), code.cast("int") + 1).alias("name"))


def syslog_extract_facility(priority: Column) -> Column:
    p = priority.try_cast("int")
    return F.when(p.between(0, 191), _coded(F.floor(p / 8), FACILITIES))


def syslog_extract_severity(priority: Column) -> Column:
    p = priority.try_cast("int")
    return F.when(p.between(0, 191), _coded((p % 8).cast("bigint"), SEVERITIES))


# arrays of structs -----------------------------------------------------------------------------
def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9]+", "_"))


def _last_of_each_key(entries: Column) -> Column:
    """Entries whose key does not come again later."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))


def array_obj_to_map_kv(array: Column, key: str, value: str) -> Column:
    """Map of key field → value field; incomplete elements are skipped, of equal keys the last wins."""
    whole = F.filter(array, lambda x: x[key].isNotNull() & x[value].isNotNull())
    return F.map_from_entries(_last_of_each_key(F.transform(whole, lambda x: F.struct(snake(x[key]).alias("key"), x[value].alias("value")))))


def array_extract_key_obj(array: Column, key: str, new_value: str, old_value: str) -> Column:
    """Map of key field → {new, old}; an empty old value is left null."""
    whole = F.filter(array, lambda x: x[key].isNotNull())
    return F.map_from_entries(_last_of_each_key(F.transform(whole, lambda x: F.struct(snake(x[key]).alias("key"), F.struct(x[new_value].alias("new"), F.when(x[old_value] != "", x[old_value]).alias("old")).alias("value")))))


MAPPINGS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        *(concat, concat_any, downcase, upcase, join, decode_base16, hex_to_number, regex_extract, sha1, to_string, int_calculate, float_calculate, to_bool, to_int),
        *(date_from_epoch, date_to_epoch, get_date, system_epoch, iana_protocol_number_to_name, iana_protocol_name_to_number, ip_version, network_community_id),
        *(syslog_extract_facility, syslog_extract_severity, array_obj_to_map_kv, array_extract_key_obj),
    )
}
