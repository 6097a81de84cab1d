"""Writers. Re-runs replace or refuse as asked; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter


def _exact_error(x: Column, scale: Column) -> Column:
    """What ``x * scale`` loses when rounded to a double (Dekker's product)."""
    def halves(v):
        big = v * 134217729.0
        hi = big - (big - v)
        return hi, v - hi

    x_hi, x_lo = halves(x)
    s_hi, s_lo = halves(scale)
    return ((x_hi * s_hi - x * scale) + x_hi * s_lo + x_lo * s_hi) + x_lo * s_lo


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _power_of_ten(exponents: range, index: Column) -> Column:
    return F.get(F.array(*[F.lit(10.0 ** e) for e in exponents]), F.greatest(F.lit(0), index))


def six_digits(x: Column) -> Column:
    """Text with six significant digits, no trailing zeros, exponent form outside 1e-4 .. 1e6; null is ''.

    Rounding follows the exact binary value, ties to even, as C formatting does.
    """
    trim = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    def rounded(whole, rest, half, error):
        up = (rest > half) | ((rest == half) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        return whole + up.cast("long")

    def plain(a, power):
        scale = _power_of_ten(range(9, -1, -1), power + 4)
        n = _bind(F.floor(a * scale), lambda whole: rounded(whole, a * scale - whole, F.lit(0.5), _exact_error(a, scale)))
        return _bind(n, lambda v: F.when((power == 5) & (v >= 1000000), "1e+06").otherwise(trim(F.format_string("%.9f", v / scale))))

    def large(a, power):
        unit = _power_of_ten(range(1, 18), power - 6)
        n = _bind(a % unit, lambda rest: rounded(((a - rest) / unit).cast("long"), rest, unit / 2, F.lit(0.0)))
        text = lambda v, p: F.concat(trim(F.format_string("%.5f", v / 100000.0)), F.format_string("e+%02d", p))
        return _bind(n, lambda v: F.when(v >= 1000000, text(v / 10, power + 1)).otherwise(text(v, power)))

    def far(a):
        sci = F.format_string("%.5e", a)
        exponent = F.regexp_extract(sci, r"(e[+-]\d+)$", 1)
        return F.when(exponent == "e-04", "0.0001").otherwise(F.concat(trim(F.regexp_extract(sci, r"^(.*)e", 1)), exponent))

    def positive(a):
        power = F.regexp_extract(F.format_string("%.16e", a), r"e([+-]\d+)$", 1).cast("int")
        return _bind(power, lambda p: F.when(p.between(-4, 5), plain(a, p)).when(p.between(6, 22), large(a, p)).otherwise(far(a)))

    text = F.when(x == 0, "0").otherwise(_bind(F.abs(x), positive))
    text = F.when(x < 0, F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(x.isNull() | F.isnan(x), "").otherwise(text)


def write_by_station(df: DataFrame, path: str, overwrite: bool = False, per_task: int = 0) -> None:
    """One table partitioned by station serves as the per-station files and the combined one.

    Rows are spread by (station, day) before writing, so a hot station is written by many tasks.
    """
    keys = [c for c in ("station", "local_date") if c in df.columns]
    out = df.repartition(*keys) if keys else df
    writer = out.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("station")
    if per_task:
        writer = writer.option("maxRecordsPerFile", per_task)
    writer.parquet(path)


def write_feature_text(df: DataFrame, path: str, numeric: Sequence[str], overwrite: bool = False) -> None:
    text = df.withColumns({c: six_digits(F.col(c).cast("double")) for c in numeric})
    text.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("station").csv(path, header=True, emptyValue="")


def write_hour_extracts(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Gzip CSV per local hour, with the split column kept."""
    if "split" not in df.columns:
        raise ValueError("training extracts need a split column")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("local_hour")
    writer.option("compression", "gzip").csv(path, header=True)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Report tables are aggregates of bounded size; they go to one file."""
    one = df.coalesce(1).write.mode("overwrite")
    one.csv(path, header=True) if kind == "csv" else one.json(path)


def write_ledger(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Columns in schema order; the input must not read from ``path``."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, emptyValue="")


def append_json(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def record_raw(stream: DataFrame, path: str, checkpoint: str, source: str = "source", per_file: int = 1_000_000) -> DataStreamWriter:
    """Payload text per source, rolled over by record count; line ends inside are cut."""
    clean = stream.withColumn("payload", F.regexp_replace("payload", r"[\r\n]+$", ""))
    return append_json(clean, path, checkpoint).partitionBy(source).option("maxRecordsPerFile", per_file)
