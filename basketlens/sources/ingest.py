"""CSV ingest: orders export and daily traffic export, with quarantine.

The exports are text: ``;``-separated orders with a decimal comma and
``dd.mm.yyyy`` dates, and a ``,``-separated daily traffic file whose counts
carry a no-break space as thousands separator.  Files are read with an
all-string schema (no inference pass over 100 TB), then typed with ``try_*``
expressions; a row whose typed value is NULL while its text was not is a
bad row.  Instead of stopping at the first bad row (which makes the loaded
content depend on row order), bad rows go to a quarantine frame with the raw
text, a reason and where they come from (file, and the byte at which the task's
part of it begins), and the good rows load as a whole.

A stored table is either replaced or appended to as a whole, or kept as
*loads*: each export is a folder ``load=<name>`` of its own, which a repeated
load replaces and :func:`drop_load` empties, so loading the same file twice
changes nothing and a load by mistake can be taken back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketlens.functions.numeric import ascii_digits

PRICE_TYPE = "decimal(10,1)"

RAW_LINE = "raw_line"  # the whole line of a row with too few or too many fields
ORIGIN = ("source_file", "block_start")  # of a row read from files


@dataclass(frozen=True)
class ParseResult:
    good: DataFrame
    rejected: DataFrame


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def parse_day_month_year(text: Column) -> Column:
    """``dd.mm.yyyy`` (one- or two-digit day and month, ``.`` or ``-``) -> date;
    NULL for anything else, including impossible dates such as 31.02."""
    return F.try_to_date(F.translate(F.trim(ascii_digits(text)), ".", "-"), "d-M-yyyy")


def parse_decimal_comma(text: Column, to_type: str = PRICE_TYPE) -> Column:
    """``12,25`` -> 12.3 in ``decimal(10,1)`` (HALF_UP); NULL if not a number.
    Compatibility digits (full width, superscript, ...) are read as digits."""
    return F.replace(F.trim(ascii_digits(text)), F.lit(","), F.lit(".")).try_cast(to_type)


def parse_grouped_int(text: Column) -> Column:
    """``3<U+00A0>715`` -> 3715: drop every space or separator, then cast."""
    return F.regexp_replace(ascii_digits(text), r"[\p{Z}\s]", "").try_cast("int")


ORDERS_TYPED = ("id_o", "user_id", "price", "o_date")
TRAFFIC_TYPED = ("day", "users")


def _told(df: DataFrame) -> list[str]:
    """What the reader tells about each row, as far as there is any."""
    return [c for c in (RAW_LINE, *ORIGIN) if c in df.columns]


def _field_count(raw: DataFrame) -> Column:
    """``wrong number of fields`` for lines that the CSV reader marked, else NULL."""
    bad = F.col(RAW_LINE).isNotNull() if RAW_LINE in raw.columns else F.lit(False)
    return F.when(bad, F.lit("wrong number of fields"))


def tag_orders(raw: DataFrame, id_max_length: int | None = None, price_type: str = PRICE_TYPE) -> DataFrame:
    """Raw orders with typed twins ``_id_o, _user_id, _price, _o_date`` and
    ``reject_reason`` (NULL for a good row).  ``id_max_length`` rejects longer
    ids (no check by default); a number beyond ``price_type`` is rejected as
    ``price out of range``."""
    id_o = F.trim(F.col("id_o"))
    user_id = F.trim(F.col("user_id"))
    price = parse_decimal_comma(F.col("price"), price_type)
    number = parse_decimal_comma(F.col("price"), "decimal(38,1)")
    o_date = parse_day_month_year(F.col("o_date"))

    reason = (
        _field_count(raw)
        .when(_blank(F.col("id_o")), F.lit("missing id_o"))
        .when(_blank(F.col("user_id")), F.lit("missing user_id"))
    )
    if id_max_length is not None:
        reason = (
            reason.when(F.length(id_o) > id_max_length, F.lit("id_o too long"))
            .when(F.length(user_id) > id_max_length, F.lit("user_id too long"))
        )
    reason = (
        reason.when(price.isNull() & number.isNotNull(), F.lit("price out of range"))
        .when(price.isNull(), F.lit("bad price"))
        .when(o_date.isNull(), F.lit("bad date"))
    )
    return raw.select(
        "*",
        id_o.alias("_id_o"),
        user_id.alias("_user_id"),
        price.alias("_price"),
        o_date.alias("_o_date"),
        reason.alias("reject_reason"),
    )


def _split(tagged: DataFrame, typed: tuple[str, ...]) -> ParseResult:
    """Good rows (typed) and rejected rows (raw text and reason).

    The typed values and the reason leave the parsing step through a
    one-element ``inline``; the row filters then read those columns.  (A
    filter over a plain projection is pushed below it with the parse
    expressions copied in, so every row would be parsed twice.)
    """
    line = _told(tagged)
    once = tagged.select(
        *typed,
        *line,
        F.inline(F.array(F.struct(*[F.col(f"_{c}").alias(f"typed_{c}") for c in typed], "reject_reason"))),
    )
    good = once.where(F.col("reject_reason").isNull()).select(*[F.col(f"typed_{c}").alias(c) for c in typed])
    rejected = once.where(F.col("reject_reason").isNotNull()).select(*typed, *line, "reject_reason")
    return ParseResult(good, rejected)


def parse_orders(raw: DataFrame, id_max_length: int | None = None, price_type: str = PRICE_TYPE) -> ParseResult:
    """Type a raw orders frame ``(id_o, user_id, price, o_date)`` of strings.

    Good rows: ``id_o string, user_id string, price decimal(10,1), o_date date``.
    Rejected rows keep the raw columns plus ``reject_reason``.  (Lazy
    frames, each parses its rows once; to produce both from one read of the
    input use :func:`store_parsed`.)
    """
    return _split(tag_orders(raw, id_max_length, price_type), ORDERS_TYPED)


def tag_daily_traffic(raw: DataFrame) -> DataFrame:
    """Raw traffic rows (empty days skipped) with typed twins ``_day, _users``
    and ``reject_reason``."""
    empty = _blank(F.col("day"))
    rows = raw.where(~empty | F.col(RAW_LINE).isNotNull()) if RAW_LINE in raw.columns else raw.where(~empty)
    users_text = F.coalesce(F.nullif(F.trim(F.col("users")), F.lit("")), F.lit("0"))
    day = parse_day_month_year(F.col("day"))
    users = parse_grouped_int(users_text)
    reason = _field_count(raw).when(day.isNull(), F.lit("bad day")).when(users.isNull(), F.lit("bad users"))
    return rows.select("*", day.alias("_day"), users.alias("_users"), reason.alias("reject_reason"))


def parse_daily_traffic(raw: DataFrame) -> ParseResult:
    """Type a raw traffic frame ``(day, users)`` of strings.

    An empty day is skipped (neither loaded nor rejected); empty users
    count as 0.  Good rows: ``day date, users int``.
    """
    return _split(tag_daily_traffic(raw), TRAFFIC_TYPED)


def store_parsed(
    spark: SparkSession,
    tagged: DataFrame,
    typed: tuple[str, ...],
    path: str,
    mode: Literal["overwrite", "append"] = "overwrite",
    load: str | None = None,
) -> ParseResult:
    """Write good and rejected rows in *one* pass, as partitions
    ``status=good`` / ``status=rejected`` of one Parquet table, and return
    both read back.

    Each input row is read and typed once (two lazy filters over the same
    input would parse every row twice), the write commits as one job, and
    later steps read the stored table, not the text export.  An overwrite
    replaces the whole table, also a partition that the new load leaves empty.  ``mode='append'``
    adds a new export (say, the next day's) to the table in one commit; done
    twice, it doubles the rows.  With ``load``, the name of the export, the
    table is one of loads: this one is replaced whole (its rejected rows too),
    the others stay, and the frames returned are those of all loads.
    """
    ok = F.col("reject_reason").isNull()
    line = _told(tagged)
    out = tagged.select(
        *[F.when(ok, F.col(f"_{c}")).alias(c) for c in typed],
        *[F.when(~ok, F.col(c)).alias(f"raw_{c}") for c in typed],
        *line,
        "reject_reason",
        F.when(ok, F.lit("good")).otherwise(F.lit("rejected")).alias("status"),
    )
    folder = path if load is None else _load_folder(path, load)
    replaced = mode if load is None else "overwrite"
    out.write.mode(replaced).option("partitionOverwriteMode", "static").partitionBy("status").parquet(folder)
    stored = spark.read.schema(out.schema if load is None else out.schema.add(LOAD, "string")).parquet(path)
    good = stored.where(F.col("status") == "good").select(*typed)
    rejected = stored.where(F.col("status") == "rejected").select(
        *[F.col(f"raw_{c}").alias(c) for c in typed], *line, "reject_reason"
    )
    return ParseResult(good, rejected)


LOAD = "load"  # partition column of a table of loads


def _load_folder(path: str, load: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", load):
        raise ValueError(f"a load is named by letters, digits and _.-, not {load!r}")
    return f"{path.rstrip('/')}/{LOAD}={load}"


def drop_load(spark: SparkSession, path: str, load: str, typed: tuple[str, ...]) -> None:
    """Take a load back: its folder is overwritten with no rows, the others stay."""
    names = ", ".join(f"{c} string" for c in (*typed, "status"))
    spark.createDataFrame([], names).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("status").parquet(_load_folder(path, load))


def _read_csv(spark: SparkSession, path: str, names: tuple[str, ...], **options: str) -> DataFrame:
    """An export as strings, columns taken by the names in its header (without
    quotes and spaces, lower case), whatever their order; all must be there
    and no others.  The header of every file is held against the first one.
    Lines with another number of fields keep their text in ``raw_line``; each
    row has its file and the start of its block in it."""
    written = spark.read.options(header=True, encoding="UTF-8", **options).csv(path).columns  # reads the header line only
    found = [c.replace('"', "").replace("`", "").replace("\ufeff", "").strip().lower() for c in written]
    if sorted(found) != sorted(names):
        raise ValueError(f"columns {sorted(names)} are needed, the header has {found}")
    schema = StructType([StructField(c, StringType()) for c in [*written, RAW_LINE]])
    strict = {"columnNameOfCorruptRecord": RAW_LINE, "enforceSchema": False, "columnPruning": False}
    raw = spark.read.options(header=True, encoding="UTF-8", **options, **strict).schema(schema).csv(path)
    position = {"source_file": "_metadata.file_path", "block_start": "_metadata.file_block_start"}
    read = raw.select(*(F.col(f"`{c}`") for c in raw.columns), *(F.col(position[c]).alias(c) for c in ORIGIN))
    return read.toDF(*found, RAW_LINE, *ORIGIN).select(*names, RAW_LINE, *ORIGIN)


def read_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw orders export as strings (``;``, quoted header, ``\\r\\n`` ends)."""
    return _read_csv(spark, path, ORDERS_TYPED, sep=";", quote='"')


def read_daily_traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw daily traffic export as strings (``,``, header ``day,users``)."""
    return _read_csv(spark, path, TRAFFIC_TYPED, sep=",")


def _finish(result: ParseResult, on_error: Literal["quarantine", "fail"]) -> ParseResult:
    if on_error == "fail" and not result.rejected.isEmpty():
        sample = result.rejected.limit(5).collect()
        raise ValueError(f"rejected rows in input, first ones: {sample}")
    return result


def load_orders(
    spark: SparkSession,
    path: str,
    on_error: Literal["quarantine", "fail"] = "quarantine",
    id_max_length: int | None = None,
    price_type: str = PRICE_TYPE,
) -> ParseResult:
    """Read and type an orders export.  ``on_error='fail'`` raises if any row
    is bad (one extra job that stops at the first bad row found)."""
    return _finish(parse_orders(read_orders_csv(spark, path), id_max_length, price_type), on_error)


def load_daily_traffic(
    spark: SparkSession, path: str, on_error: Literal["quarantine", "fail"] = "quarantine"
) -> ParseResult:
    """Read and type a daily traffic export."""
    return _finish(parse_daily_traffic(read_daily_traffic_csv(spark, path)), on_error)


def ingest_orders_table(
    spark: SparkSession,
    src: str,
    dest: str,
    id_max_length: int | None = None,
    mode: Literal["overwrite", "append"] = "overwrite",
    price_type: str = PRICE_TYPE,
    load: str | None = None,
) -> ParseResult:
    """Job: orders export at ``src`` -> typed table at ``dest`` (with its
    quarantine partition), one pass over the text; ``load`` as in :func:`store_parsed`."""
    tagged = tag_orders(read_orders_csv(spark, src), id_max_length, price_type)
    return store_parsed(spark, tagged, ORDERS_TYPED, dest, mode, load)


def ingest_daily_traffic_table(
    spark: SparkSession, src: str, dest: str, mode: Literal["overwrite", "append"] = "overwrite", load: str | None = None
) -> ParseResult:
    """Job: daily traffic export at ``src`` -> typed table at ``dest``; ``load`` as in :func:`store_parsed`."""
    return store_parsed(spark, tag_daily_traffic(read_daily_traffic_csv(spark, src)), TRAFFIC_TYPED, dest, mode, load)
