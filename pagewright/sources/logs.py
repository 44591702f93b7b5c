"""Access-log lines and crawler address ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions import numbers, urls

#: The combined log format, field by field: name (empty where it isn't kept), expression.
FORMAT = (
    ("ip", r"(\S+)"), ("", r"\S+"), ("", r"\S+"), ("at", r"\[([^\]]+)\]"), ("path", r'"[A-Z]+ (\S+)(?: [^"]*)?"'), ("status", r"(\d{3})"),
    ("bytes", r"(\d+|-)"), ("", r'"[^"]*"'), ("user_agent", r'"([^"]*)"'),
)
NAMES = tuple(name for name, _ in FORMAT if name) + ("latency",)
PATTERN = "^" + " ".join(expression for _, expression in FORMAT) + r"(?: ([0-9.]+))?\s*$"
# User-agent marks of crawler families, first match wins, and host suffixes of their official names.
FAMILIES = ("googlebot", "bingbot", "gptbot", "perplexitybot")
OFFICIAL_SUFFIXES = {
    "googlebot": (".googlebot.com", ".google.com", ".googleusercontent.com"),
    "bingbot": (".search.msn.com",),
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip log files, with the file each came from."""
    return spark.read.text(path).withColumn("file", F.input_file_name())


def bot_family(user_agent: Column) -> Column:
    low, out = F.lower(user_agent), None
    for name in FAMILIES:
        out = F.when(low.contains(name), name) if out is None else out.when(low.contains(name), name)
    return out


def parse_lines(lines: DataFrame, latency_unit: str = "seconds", keep_query: bool = False) -> DataFrame:
    """Add the fields of a combined-format line of any length; every field is null on a malformed line."""
    mark = "\u0001"
    # One pass of the pattern writes all fields; a line it does not match stays one field.
    pieces = F.split(F.regexp_replace("value", PATTERN, mark.join(f"${i + 1}" for i in range(len(NAMES)))), mark)

    def fields(x: Column) -> Column:
        get = lambda name: F.get(x, F.lit(NAMES.index(name)))
        raw = get("latency").try_cast("double")
        latency = {"seconds": raw * 1000, "microseconds": raw / 1000, "none": F.lit(None).cast("double")}[latency_unit]
        path = get("path") if keep_query else F.regexp_extract(get("path"), r"^([^?]*)", 1)
        return F.struct(
            F.try_to_timestamp(get("at"), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("at"), get("ip").alias("ip"), path.alias("path"), get("status").try_cast("int").alias("status"),
            get("bytes").try_cast("long").alias("bytes"), get("user_agent").alias("user_agent"), latency.alias("latency_ms"), bot_family(get("user_agent")).alias("family"),
        )

    whole = lambda r: F.when(r["at"].isNotNull(), r)
    parsed = urls.let(pieces, lambda x: F.when(F.size(x) == len(NAMES), urls.let(fields(x), whole)))
    return lines.withColumn("_line", parsed).select(*lines.columns, "_line.*")


def published_ranges(files: DataFrame) -> DataFrame:
    """(family, lo, hi) bounds, distinct, from published prefix documents given as (family, text)."""
    schema = "creationTime string, prefixes array<struct<ipv4Prefix:string,ipv6Prefix:string>>"
    cidr = (
        files.select("family", F.from_json("text", schema).alias("d"))
        .select("family", F.explode("d.prefixes").alias("p"))
        .select("family", F.explode(F.array_compact(F.array("p.ipv4Prefix", "p.ipv6Prefix"))).alias("cidr"))
        .select("family", F.trim("cidr").alias("cidr"))
        .distinct()
    )
    return cidr_bounds(cidr)


def cidr_bounds(cidrs: DataFrame) -> DataFrame:
    """(family, cidr, version, bits, prefix, lo, hi) of IPv4 and IPv6 ranges; malformed ranges are dropped.

    ``prefix`` is the text of the leading bits that all addresses of the range share; lo and hi are numbers for IPv4.
    """
    base = F.split("cidr", "/")
    shaped = cidrs.withColumn("_a", numbers.address_bits(F.get(base, F.lit(0)))).withColumn("bits", F.get(base, F.lit(1)).try_cast("int"))
    rows = shaped.where(F.col("_a").isNotNull() & F.col("bits").between(0, F.length("_a"))).withColumn("prefix", F.expr("substring(_a, 1, bits)"))
    end = lambda fill: F.when(F.length("_a") == 32, F.conv(F.rpad("prefix", 32, fill), 2, 10).cast("long"))
    return rows.select("family", "cidr", F.when(F.length("_a") == 32, 4).otherwise(6).alias("version"), "bits", "prefix", end("0").alias("lo"), end("1").alias("hi"))
