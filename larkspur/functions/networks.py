"""Network addresses: IPv4 as numbers in the JVM; IPv6, which has no such form, by an Arrow UDF."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ipv4(address: Column) -> Column:
    """The number of a dotted address; NULL for what is none."""
    parts = F.split(address, r"\.")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    return F.when(address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?!$)|$)){4}$"), value)


def in_cidr(address: Column, network: Column) -> Column:
    """Whether an IPv4 address lies in a network such as 10.0.0.0/21."""
    size = F.pow(F.lit(2), F.lit(32) - F.split_part(network, F.lit("/"), F.lit(2)).cast("int")).cast("long")
    base = ipv4(F.split_part(network, F.lit("/"), F.lit(1)))
    return F.floor(ipv4(address) / size) == F.floor(base / size)


@F.pandas_udf(T.StringType())
def ipv6_text(address: pd.Series) -> pd.Series:
    """The short form of an IPv6 address; NULL for what is none."""

    def short(x):
        try:
            return str(ipaddress.IPv6Address(x))
        except ValueError:
            return None

    return address.map(short, na_action="ignore")


def mac(address: Column) -> Column:
    """A MAC address in lower case with colons; NULL for what is none."""
    digits = F.lower(F.regexp_replace(address, "[:.-]", ""))
    return F.when(digits.rlike("^[0-9a-f]{12}$"), F.concat_ws(":", *[F.substring(digits, 1 + 2 * k, 2) for k in range(6)]))
