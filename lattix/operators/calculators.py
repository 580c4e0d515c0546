"""Column calculators: unary, binary, special and date parts.  Undefined in, undefined out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.functions.scalars import finite, literal, ratio, scalars, with_rank

UNARY = {
    "assign": lambda x: x, "negate": lambda x: -x, "invert": lambda x: ratio(F.lit(1.0), x), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
    "log10": lambda x: F.when(x > 0, F.log10(x)), "ln": lambda x: F.when(x > 0, F.ln(x)),
}
BINARY = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": ratio,
    "power": lambda a, b: F.when(((a == 0) & (b < 0)) | ((a < 0) & (b != F.floor(b))), None).otherwise(finite(F.pow(a, b))),
}
DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
SCALED = ("deviation", "standardize", "mad", "range_adjust", "range_standardize")


def unary(df: DataFrame, op: str, x: str, into: str) -> DataFrame:
    return df.withColumn(into, UNARY[op](F.col(x).cast("double")))


def binary(df: DataFrame, op: str, a: str, b: str, into: str) -> DataFrame:
    return df.withColumn(into, BINARY[op](F.col(a).cast("double"), F.col(b).cast("double")))


def rescale(df: DataFrame, op: str, x: str, into: str) -> DataFrame:
    """Whole-column transforms: deviation from the mean, z (n-1), mean absolute deviation, x/(max-min), (x-min)/(max-min)."""
    c = F.col(x).cast("double")
    s = scalars(df, mean=F.avg(c), sd=F.stddev_samp(c), lo=F.min(c), hi=F.max(c))
    mean, lo = literal(s["mean"]), literal(s["lo"])
    wide = literal(None if s["hi"] is None else s["hi"] - s["lo"])
    if op == "deviation":
        out = c - mean
    elif op == "standardize":
        out = ratio(c - mean, literal(s["sd"]))
    elif op == "mad":
        mad = scalars(df, mad=F.avg(F.abs(c - mean)))["mad"]
        out = (c - mean) / mad if mad else c
    elif op == "range_adjust":
        out = ratio(c, wide)
    else:
        out = ratio(c - lo, wide)
    return df.withColumn(into, out)


def enumerate_rows(df: DataFrame, order: str, into: str, start: float = 0.0, step: float = 1.0) -> DataFrame:
    return with_rank(df, [F.col(order)], "__r").withColumn(into, F.lit(float(start)) + F.lit(float(step)) * (F.col("__r") - 1)).drop("__r")


def rotate(df: DataFrame, order: str, x: str, into: str, up: bool) -> DataFrame:
    """Circular shift by one row: up takes the next row's value, down the one before."""
    r = with_rank(df, [F.col(order)], "__r")
    n = scalars(df, n=F.count("*"))["n"]
    from_ = F.pmod(F.col("__r") + (-2 if up else 0), F.lit(n)) + 1
    other = r.select(from_.alias("__r"), F.col(x).alias(into))
    return r.join(other, "__r").drop("__r")


def shuffle(df: DataFrame, order: str, x: str, into: str, seed: int) -> DataFrame:
    """A permutation of the column: values ranked by a hash of (seed, row) meet rows ranked by their order."""
    rows = with_rank(df, [F.col(order)], "__r")
    mixed = with_rank(df.select(F.col(order).alias("__o"), F.col(x).alias(into)), [F.xxhash64(F.lit(seed), "__o"), F.col("__o")], "__r").drop("__o")
    return rows.join(mixed, "__r").drop("__r")


def uniform(key: Column, seed: int) -> Column:
    """Uniform in (0, 1) from (seed, row): the same however rows are partitioned."""
    return (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal(key: Column, seed: int, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller on two counter-based uniforms."""
    return F.lit(mean) + F.lit(sd) * F.sqrt(-2 * F.ln(uniform(key, seed))) * F.cos(6.283185307179586 * uniform(key, seed + 1))


def date_part(df: DataFrame, part: str, t: str, into: str) -> DataFrame:
    return df.withColumn(into, DATE_PARTS[part](F.col(t)).cast("long"))


DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
    "M/d/yyyy", "dd.MM.yyyy", "HH:mm:ss", "HH:mm",
)


def parse_dates(df: DataFrame, column: str, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> DataFrame:
    """df with the date-time of a text column as the whole number YYYYMMDDhhmmss: the first of the formats that reads a value;
    times alone have the date 0; a two-digit year (M/d/yy) below 50 is 20yy, else 19yy; what none reads is undefined."""
    text = F.trim(F.col(column).cast("string"))
    parts = F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 2)
    short = F.when(parts != "", F.concat(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/)(\d{2})$", 1), F.when(parts < "50", F.lit("20")).otherwise(F.lit("19")), parts))
    tries = [F.date_format(F.try_to_timestamp(F.coalesce(short, text), F.lit(f)), "HHmmss" if f[0] == "H" else "yyyyMMddHHmmss").cast("long") for f in formats]
    return df.withColumn(name, F.coalesce(*tries))


def is_date_column(df: DataFrame, column: str) -> bool:
    """Whether every defined, non-blank value of a text column is a date or time that parse_dates reads, and there is one."""
    from lattix.functions.scalars import scalars

    d = parse_dates(df.where(F.trim(F.col(column).cast("string")) != ""), column, "__t")
    s = scalars(d, n=F.count("*"), known=F.count("__t"))
    return s["n"] > 0 and s["n"] == s["known"]
