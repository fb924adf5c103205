"""IP prefixes as columns. IPv4 stays in built-in functions; IPv6 text is parsed by one Arrow function."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prefixes that features leave out, the shortest lengths that count, and the reasons.
EXCLUDED = ("120.0.0.0/11", "173.0.0.0/11")
SHORTEST_V4, SHORTEST_V6 = 8, 16
SKIP_REASONS = ("manually_excluded_prefix", "oversized_ipv4_prefix", "oversized_ipv6_prefix")

_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})/(\d{1,2})$"
CIDR_TYPE = T.StructType(
    [T.StructField("prefix", T.StringType()), T.StructField("afi", T.IntegerType()), T.StructField("plen", T.IntegerType()), T.StructField("hi", T.DecimalType(20, 0)), T.StructField("lo", T.DecimalType(20, 0))]
)


def v4_parts(prefix: Column) -> Column:
    """struct(network, length, size) of an IPv4 prefix, host bits cleared; NULL for anything else. The text is matched once."""
    numbers = F.transform(F.split(F.when(prefix.rlike(_V4), prefix), "[./]"), lambda x: x.cast("bigint"))

    def parts(n: Column) -> Column:
        address = n[0] * (1 << 24) + n[1] * (1 << 16) + n[2] * (1 << 8) + n[3]
        size = F.pow(F.lit(2.0), F.lit(32) - n[4]).cast("bigint")
        valid = (n[4] <= 32) & F.forall(F.slice(n, 1, 4), lambda x: x <= 255)
        return F.when(valid, F.struct((address - F.pmod(address, size)).alias("network"), n[4].cast("int").alias("length"), size.alias("size")))

    return F.get(F.transform(F.array(numbers), parts), 0)


def v4_length(prefix: Column) -> Column:
    return v4_parts(prefix)["length"]


def v4_network(prefix: Column) -> Column:
    """The 32-bit network number with host bits cleared; NULL for anything but a valid IPv4 prefix."""
    return v4_parts(prefix)["network"]


def v4_size(prefix: Column) -> Column:
    """Addresses of a prefix."""
    return v4_parts(prefix)["size"]


def v4_text(network: Column, length: Column) -> Column:
    octet = lambda shift: F.shiftright(network, shift).bitwiseAND(F.lit(255).cast("bigint")).cast("string")
    return F.when(network.isNotNull(), F.concat(F.concat_ws(".", *[octet(s) for s in (24, 16, 8, 0)]), F.lit("/"), length.cast("string")))


def skip_reason(prefix: Column, afi: Column, length: Column) -> Column:
    """Why features leave a prefix out; NULL where they do not."""
    excluded, long_v4, long_v6 = SKIP_REASONS
    return F.when(prefix.isin(*EXCLUDED), excluded).when((afi == 4) & (length < SHORTEST_V4), long_v4).when((afi == 6) & (length < SHORTEST_V6), long_v6)


def v4_ancestors(network: Column, length: Column, shortest: Column | int = 1) -> Column:
    """array<struct<network, length>> of all shorter prefixes that cover one, nearest first."""
    shortest = F.lit(shortest) if isinstance(shortest, int) else shortest
    cut = lambda n: network - F.pmod(network, F.pow(F.lit(2.0), F.lit(32) - n).cast("bigint"))
    lengths = F.when(length > shortest, F.sequence(length - 1, shortest, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.struct(cut(n).alias("network"), n.cast("int").alias("length")))


def v6_words(parsed: Column) -> Column:
    """struct(hi, lo) of a ``parse_cidr`` result: the two halves of an IPv6 network as signed 64-bit words."""
    signed = lambda x: F.when(x >= F.lit(Decimal(1 << 63)), x - F.lit(Decimal(1 << 64))).otherwise(x).cast("bigint")
    return F.when(parsed["afi"] == 6, F.struct(signed(parsed["hi"]).alias("hi"), signed(parsed["lo"]).alias("lo")))


def v6_cut(network: Column, length: Column) -> Column:
    """A network of two words (hi, lo) with all bits behind ``length`` cleared."""

    def mask(bits: Column) -> Column:
        """Leading ones; none and all are set apart, as a shift by 64 bits is a shift by none."""
        some = F.greatest(F.least(bits, F.lit(63)), F.lit(1))
        ones = F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(64) - some).cast("int"))
        return F.when(bits >= 64, F.lit(-1).cast("bigint")).when(bits <= 0, F.lit(0).cast("bigint")).otherwise(ones)

    return F.struct(network["hi"].bitwiseAND(mask(length)).alias("hi"), network["lo"].bitwiseAND(mask(length - 64)).alias("lo"))


def v6_ancestors(lengths: list[int]) -> Callable[[Column, Column], Column]:
    """The covering prefixes of an IPv6 network of two words, for the shorter ones of ``lengths`` (those that a table has, 128 at most)."""

    def ancestors(network: Column, length: Column) -> Column:
        shorter = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: n < length)
        return F.transform(shorter, lambda n: F.struct(v6_cut(network, n).alias("network"), n.cast("int").alias("length")))

    return ancestors


@F.pandas_udf(CIDR_TYPE)
def parse_cidr(prefixes: pd.Series) -> pd.DataFrame:
    """Canonical text, family, length and the 64-bit halves of the network; all NULL for invalid text."""
    rows = []
    for text in prefixes:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except (ValueError, TypeError):
            rows.append((None, None, None, None, None))
            continue
        bits = int(net.network_address)
        rows.append((str(net), net.version, net.prefixlen, Decimal(bits >> 64), Decimal(bits & ((1 << 64) - 1))))
    return pd.DataFrame(rows, columns=["prefix", "afi", "plen", "hi", "lo"], dtype=object)


class PrefixAncestors:
    """Table function: the covering prefixes of a prefix, longest first."""

    def eval(self, prefix: str):
        try:
            net = ipaddress.ip_network(prefix, strict=False)
        except (ValueError, TypeError):
            return
        while net.prefixlen > 1:
            net = net.supernet()
            yield str(net), net.prefixlen


def register(spark: SparkSession) -> None:
    """Name ``cidr_parse`` and ``prefix_ancestors`` for SQL."""
    spark.udf.register("cidr_parse", parse_cidr)
    spark.udtf.register("prefix_ancestors", F.udtf(PrefixAncestors, returnType="ancestor: string, length: int"))
