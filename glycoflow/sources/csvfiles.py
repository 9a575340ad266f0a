"""Glucose-monitor CSV exports: lines, fields, format detection, column choice, rows.

Everything works on a table of lines (file, line_no, value), read from a folder of
files in differing formats. Column choices are made once per file; rows then pick their
fields by position, so files of all formats go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions import dates, glucose
from glycoflow.functions.jsmath import parse_number

LINES_PER_BLOCK = 100_000
#: Columns that are read at least; exports have about twenty.
WIDTH = 64
CSV_OPTIONS = {
    "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
}
#: Columns that Spark's parser allows by itself.
MAX_COLUMNS = 20480


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files under `path` as (file, line_no, value), line_no from 1.

    A file may span many splits: positions inside a split come from the scan, and each
    split is offset by the line counts of the splits before it.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_replace("value", r"\r$", "").alias("value"),
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    splits = (
        read.groupBy("file", "split")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
        .withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    return read.join(splits.select("file", "split", "first_row", "offset"), ["file", "split"]).select(
        "file", (F.col("offset") + F.col("row") - F.col("first_row") + 1).alias("line_no"), "value"
    )


def widest(lines: DataFrame) -> int:
    """Most fields of a line, `WIDTH` at least; separators inside quotes count, too."""
    most = lines.agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0]
    return max(WIDTH, (most or 0) + 1)


def with_fields(lines: DataFrame, width: int | None = None) -> DataFrame:
    """Adds `cells`, the fields of each line; a missing or empty field is ''.

    Spark's CSV parser reads a line into a row of `width` texts, by default as many as the
    widest line has. The parsed row is a column of its own before its fields are taken, so
    a line is parsed once.
    """
    width = widest(lines) if width is None else width
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {**CSV_OPTIONS, "maxColumns": str(max(width, MAX_COLUMNS))}
    parsed = lines.withColumn("_csv", F.from_csv("value", schema, options))
    cells = F.array(*[F.trim(F.coalesce(F.col(f"_csv.c{i}"), F.lit(""))) for i in range(width)])
    return parsed.withColumn("cells", cells).drop("_csv")


def _used(cells: Column) -> Column:
    """Cells up to the last one that is not empty."""
    last = F.array_max(F.transform(cells, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return F.slice(cells, F.lit(1), F.coalesce(last, F.lit(0)))


def _filled(lines: DataFrame) -> DataFrame:
    return lines.filter(F.trim("value") != "")


def _first_two(lines: DataFrame) -> DataFrame:
    """Of every file the two first lines that are not blank, cut map-side; `_rn` is 1 or 2."""
    order = Window.partitionBy("file").orderBy("line_no")
    return _filled(lines).withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= 2)


def header_width(lines: DataFrame) -> int:
    """Columns to read so that no header is cut."""
    return widest(_first_two(lines).filter(F.col("_rn") == 1))


def file_heads(lines: DataFrame, width: int | None = None) -> DataFrame:
    """Per file its headers and the fields of its first data row."""
    width = header_width(lines) if width is None else width
    cells = with_fields(_first_two(lines), width)
    return cells.groupBy("file").agg(
        F.max(F.when(F.col("_rn") == 1, _used(F.col("cells")))).alias("headers"),
        F.max(F.when(F.col("_rn") == 2, F.col("cells"))).alias("first_cells"),
    )


def records(lines: DataFrame, width: int | None = None) -> DataFrame:
    """Data rows as (file, line_number, cells); the header is line 1, blank lines do not count.

    A row has as many cells as its file has headers. Rows are numbered inside blocks of lines and offset by the counts of earlier blocks,
    so one huge file is still numbered by many tasks.
    """
    width = header_width(lines) if width is None else width
    filled = _filled(lines).withColumn("_block", F.expr(f"line_no div {LINES_PER_BLOCK}"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        filled.groupBy("file", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("file", "_block").orderBy("line_no")
    return (
        filled.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, ["file", "_block"])
        .select("file", (F.col("_offset") + F.col("_rn")).alias("line_number"), "value")
        .filter(F.col("line_number") > 1)
        .transform(with_fields, width)
        .join(file_heads(lines, width).select("file", F.size("headers").alias("_width")), "file")
        .select("file", "line_number", F.slice("cells", F.lit(1), F.col("_width")).alias("cells"))
    )


def file_formats(lines: DataFrame) -> DataFrame:
    """`freestyle-libre`, `dexcom` or `generic` per file, from its first five lines."""

    def marked(words: list[str]) -> Column:
        hit = None
        for word in words:
            test = F.contains(F.lower("value"), F.lit(word))
            hit = test if hit is None else hit | test
        return F.coalesce(F.max(hit), F.lit(False))

    return (
        lines.filter(F.col("line_no") <= 5)
        .groupBy("file")
        .agg(
            F.when(marked(values.LIBRE_MARKERS), F.lit("freestyle-libre"))
            .when(marked(values.DEXCOM_MARKERS), F.lit("dexcom"))
            .otherwise(F.lit("generic"))
            .alias("format")
        )
    )


def position_of(headers: Column, patterns: list[str]) -> Column:
    """Position (from 0) of the first header holding the first pattern that any header holds."""

    def first(pattern: str) -> Column:
        hits = F.transform(headers, lambda h: F.contains(F.lower(h), F.lit(pattern.lower())))
        return F.nullif(F.array_position(hits, F.lit(True)), F.lit(0))

    return F.coalesce(*[first(pattern) for pattern in patterns]) - 1


def suggest_mapping(heads: DataFrame) -> DataFrame:
    """Header names that look like timestamp, value, unit and device; NULL names if either
    of the first two is missing."""
    headers = F.col("headers")
    where = {n: position_of(headers, p) for n, p in values.MAPPING_PATTERNS.items()}
    usable = where["timestamp"].isNotNull() & where["value"].isNotNull()
    return heads.select(
        "file",
        *[F.when(usable, F.get(headers, at)).alias(f"{n}_column") for n, at in where.items()],
    )


def _exact(headers: Column, name: str | None) -> Column:
    if name is None:
        return F.lit(None).cast("bigint")
    return F.nullif(F.array_position(headers, F.lit(name)), F.lit(0)) - 1


def file_columns(heads: DataFrame, formats: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Per file the positions to read, its glucose unit and its device.

    `mapping` (timestamp, value and optionally unit, device) names the columns of generic
    files; without it they are inferred.
    """
    headers = F.col("headers")
    looked_up = {}
    for style, columns in (
        ("libre", values.LIBRE_COLUMNS), ("dexcom", values.DEXCOM_COLUMNS),
        ("generic", values.MAPPING_PATTERNS),
    ):
        for name, patterns in columns.items():
            if style == "generic" and mapping is not None:
                at = _exact(headers, mapping.get(name))
            else:
                at = position_of(headers, patterns)
            looked_up[f"{style}_{name}"] = at
    known = heads.join(formats, "file").select(
        "file", "format", "first_cells", *[c.alias(n) for n, c in looked_up.items()]
    )
    is_libre, is_dexcom = F.col("format") == "freestyle-libre", F.col("format") == "dexcom"
    nothing = F.lit(None).cast("bigint")

    def choose(for_libre: Column, for_dexcom: Column, for_generic: Column) -> Column:
        return F.when(is_libre, for_libre).when(is_dexcom, for_dexcom).otherwise(for_generic)

    def found(name: str) -> Column:
        return F.col(name).isNotNull()

    device_cell = F.get(
        F.col("first_cells"), F.when(is_libre, F.col("libre_device")).otherwise(F.col("dexcom_device"))
    )
    transmitter = F.rtrim(F.concat(F.lit("Dexcom "), F.coalesce(device_cell, F.lit(""))))
    return known.select(
        "file",
        "format",
        choose(
            F.col("libre_timestamp"), F.col("dexcom_timestamp"), F.col("generic_timestamp")
        ).alias("ts_at"),
        choose(
            F.coalesce("libre_mmol", "libre_mgdl"),
            F.coalesce("dexcom_mmol", "dexcom_mgdl"),
            F.col("generic_value"),
        ).alias("value_at"),
        choose(F.col("libre_record_type"), F.col("dexcom_record_type"), nothing).alias("type_at"),
        choose(nothing, nothing, F.col("generic_unit")).alias("unit_at"),
        choose(nothing, nothing, F.col("generic_device")).alias("device_at"),
        choose(
            ~found("libre_mmol"), ~found("dexcom_mmol"), F.lit(None).cast("boolean")
        ).alias("is_mgdl"),
        choose(
            device_cell,
            F.when(found("dexcom_device"), transmitter).otherwise(F.lit("Dexcom CGM")),
            F.lit(None).cast("string"),
        ).alias("file_device"),
    )


def unreadable_files(columns: DataFrame) -> DataFrame:
    """Files in which no timestamp or no glucose column was found."""
    return columns.filter(F.col("ts_at").isNull() | F.col("value_at").isNull()).select(
        "file", "format", F.lit("COLUMNS_NOT_FOUND").alias("problem")
    )


def parsed_rows(
    lines: DataFrame, mapping: dict | None = None, default_unit: str = "mmol/L",
    formats: DataFrame | None = None,
) -> DataFrame:
    """Readings of all files in mmol/L: file, format, line_number, ts, value, device."""
    known = file_formats(lines) if formats is None else formats
    width = header_width(lines)
    columns = file_columns(file_heads(lines, width), known, mapping)
    rows = records(lines, width).join(columns, "file")

    def cell(at: str) -> Column:
        return F.coalesce(F.get("cells", F.col(at)), F.lit(""))

    kind, text = F.col("format"), cell("value_at")
    wanted = (
        F.when(F.col("type_at").isNull(), F.lit(True))
        .when(kind == "freestyle-libre", cell("type_at").isin(values.LIBRE_RECORD_TYPES))
        .otherwise(cell("type_at").isin(values.DEXCOM_RECORD_TYPES))
    )
    out_of_range = (kind == "dexcom") & F.lower(text).isin("low", "high")
    unit_text = F.lower(cell("unit_at"))
    row_mgdl = (
        F.when(F.contains(unit_text, F.lit("mg")), F.lit(True))
        .when(F.contains(unit_text, F.lit("mmol")), F.lit(False))
        .otherwise(F.lit(default_unit == "mg/dL"))
    )
    ts = (
        F.when(kind == "freestyle-libre", dates.parse_libre(cell("ts_at")))
        .when(kind == "dexcom", dates.parse_iso(cell("ts_at")))
        .otherwise(dates.parse_any(cell("ts_at")))
    )
    number = parse_number(text)
    return (
        rows.filter(F.col("ts_at").isNotNull() & F.col("value_at").isNotNull())
        .filter(wanted & ~out_of_range & (cell("ts_at") != "") & (text != ""))
        .select(
            "file",
            "format",
            "line_number",
            ts.alias("ts"),
            number.alias("number"),
            F.coalesce("is_mgdl", row_mgdl).alias("mgdl"),
            F.coalesce(
                "file_device", F.when(F.col("device_at").isNotNull(), cell("device_at"))
            ).alias("device"),
        )
        .filter(F.col("ts").isNotNull() & F.col("number").isNotNull())
        .select(
            "file",
            "format",
            "line_number",
            "ts",
            F.when(F.col("mgdl"), glucose.mgdl_to_mmol(F.col("number")))
            .otherwise(F.col("number"))
            .alias("value"),
            "device",
        )
    )


def sniff_columns(table: DataFrame) -> DataFrame:
    """Which text columns look like timestamps and which like glucose, in one pass.

    A timestamp column matches a date or time pattern in at least 80 % of its values; a
    glucose column is numeric in 80 % and all its numbers lie in 2-30 or 36-540.
    """
    names = table.columns
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("text")) for n in names])
    number = parse_number(F.col("text"))
    in_range = number.between(2.0, 30.0) | number.between(36.0, 540.0)
    stamped = F.rlike(F.col("text"), F.lit(dates.TIMESTAMP_HINTS))
    n = F.count(F.lit(1))
    return (
        table.select(F.explode(pairs).alias("p"))
        .select("p.column", F.coalesce("p.text", F.lit("")).alias("text"))
        .groupBy("column")
        .agg(
            (F.count_if(stamped) >= n * 0.8).alias("is_timestamp"),
            (
                (F.count(number) >= n * 0.8) & F.coalesce(F.bool_and(in_range), F.lit(True))
            ).alias("is_bsl"),
        )
    )
