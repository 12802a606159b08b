"""Result tables: row/column training table, impact profile file, list-mode tables, event store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitframe.operators.features import choose_strongest, per_module
from hitframe.schema import MODULE, SIDE

#: Rows and columns of a module, where the caller doesn't say.
LINES = 8


def training_table(
    hits: DataFrame, x_pitch: float, y_pitch: float | None = None, parity: bool = False, lines: int = LINES
) -> DataFrame:
    """Per event side: energy sums by column (``col_0..``, by y) and row (``row_0..``, by x) of the strongest module.

    A module has ``lines`` rows and columns; a hit outside them is an error, so no energy is lost. All hit types count. ``parity`` also counts hits of the same minimodule number in other supermodules.
    """
    row = F.floor(F.col("x") / F.lit(float(x_pitch)))
    col = F.floor(F.col("y") / F.lit(float(y_pitch or x_pitch)))

    inside = row.between(0, lines - 1) & col.between(0, lines - 1)
    hits = hits.filter(F.when(inside | row.isNull() | col.isNull(), True).otherwise(F.raise_error(F.lit("hit outside the rows and columns of a module")).cast("boolean")))

    def line(index: Column, k: int, name: str) -> Column:
        return F.coalesce(F.sum(F.when(index == k, F.col("energy"))), F.lit(0.0)).alias(f"{name}_{k}")

    sums = [line(col, k, "col") for k in range(lines)] + [line(row, k, "row") for k in range(lines)]
    names = [f"{n}_{k}" for n in ("col", "row") for k in range(lines)]
    if not parity:
        picked = choose_strongest(per_module(hits, *sums), [*MODULE, *names])
    else:
        by_number = hits.groupBy(*SIDE, "mm").agg(*sums)
        picked = choose_strongest(per_module(hits), MODULE).join(by_number, [*SIDE, "mm"])
    return picked.select(*SIDE, *names, "mm", "sm")


def write_training_text(table: DataFrame, path: str) -> None:
    """Tab-separated lines with two decimals, module and supermodule last; one file per partition."""
    names = [c for c in table.columns if c.startswith(("col_", "row_"))]
    fields = [F.format_string("%.2f", c) for c in names] + [F.col("mm").cast("string"), F.col("sm").cast("string")]
    table.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)


def profile_lines(profile: DataFrame) -> DataFrame:
    """Lines of an impact profile: the mean maximum, then the mean share of every rank (bounded by the matrix size)."""

    def line(number: Column, value: Column) -> Column:
        return F.struct(number.cast("int").alias("line"), value.alias("value"))

    body = line(F.col("rank"), F.col("mean_share"))
    lines = F.when(F.col("rank") == 1, F.array(line(F.lit(0), F.col("mean_max")), body)).otherwise(F.array(body))
    return profile.select(F.inline(lines))


def write_profile(profile: DataFrame, path: str) -> None:
    """Write the profile as one ordered text file; it has at most 65 lines."""
    lines = profile_lines(profile).coalesce(1).sortWithinPartitions("line")
    lines.select(F.col("value").cast("string")).write.text(path)


# --- list mode --------------------------------------------------------------------------------------------------

# Fields of the coincidence record versions, in order, with their value range or None for a float.
BYTE, SHORT, WORD = (-128, 127), (-32768, 32767), (0, 65535)
LISTMODE = {
    "V3": [
        ("time", None), ("energy1", WORD), ("energy2", WORD), ("amount", None),
        ("xPosition1", BYTE), ("yPosition1", BYTE), ("xPosition2", BYTE), ("yPosition2", BYTE),
        ("pair", WORD),
    ],
    "V4": [
        ("time", None), ("energy1", WORD), ("energy2", WORD), ("amount", None),
        ("xPosition1", BYTE), ("yPosition1", BYTE), ("xPosition2", BYTE), ("yPosition2", BYTE),
        ("pair", WORD), ("dt", SHORT),
    ],
    "V5": [
        ("time", None), ("energy1", WORD), ("energy2", WORD), ("amount", None),
        ("xPosition1", BYTE), ("yPosition1", BYTE), ("zPosition1", BYTE),
        ("xPosition2", BYTE), ("yPosition2", BYTE), ("zPosition2", BYTE),
        ("pair", WORD), ("dt", SHORT),
    ],
}
_TYPES = {BYTE: "tinyint", SHORT: "smallint", WORD: "int", None: "float"}


def listmode_table(pairs: DataFrame, version: str, outside: str = "fail") -> DataFrame:
    """Typed coincidence table of a record version from columns of the same names.

    Whole-number fields are rounded. A value outside its field's range fails the query, or becomes NULL with
    ``outside="null"``.
    """

    def field(name: str, limits) -> Column:
        value = F.col(name)
        if limits is None:
            return value.cast("float").alias(name)
        whole = F.round(value.cast("double"))
        bad = (
            F.lit(None)
            if outside == "null"
            else F.raise_error(F.concat(F.lit(f"{name} does not fit: "), value.cast("string"))).cast("double")
        )
        checked = F.when(value.isNull(), F.lit(None)).when(whole.between(*limits), whole).otherwise(bad)
        return checked.cast(_TYPES[limits]).alias(name)

    return pairs.select(*[field(name, limits) for name, limits in LISTMODE[version]])


# Fields and types of the list-mode header.
HEADER = (
    "identifier string, rawCounts double, acqTime double, activity double, isotope string, detectorSizeX double, "
    "detectorSizeY double, startTime double, measurementTime double, moduleNumber int, ringNumber int, "
    "ringDistance double, detectorDistance double, isotopeHalfLife double, weight float, maxTemp float, "
    "percentLoss float, detectorPixelSizeX float, detectorPixelSizeY float, version array<tinyint>, breast string, "
    "gatePeriod double, DOILayer smallint, method smallint, StudyId smallint, detectorPixelsX tinyint, "
    "detectorPixelsY tinyint"
)


def listmode_header(events: DataFrame, passed: Column, **fields) -> DataFrame:
    """One-row header beside a list-mode table: ``rawCounts`` is the number of passing events, the rest is given."""
    counted = events.agg(F.count_if(passed).cast("double").alias("rawCounts"))
    columns = []
    for part in HEADER.split(", "):
        name, kind = part.split(" ")
        if name == "rawCounts":
            columns.append(F.col(name))
        else:
            columns.append(F.lit(fields.pop(name, None)).cast(kind).alias(name))
    if fields:
        raise ValueError(f"not header fields: {sorted(fields)}")
    return counted.select(*columns)


# --- event store ------------------------------------------------------------------------------------------------


def store_events(events: DataFrame, path: str, run: str) -> None:
    """Put nested events of one run into a Parquet store partitioned by run; storing a run again replaces it."""
    writer = events.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run").parquet(path)


def store_hits(hits: DataFrame, table: str, buckets: int = 2048, path: str | None = None) -> None:
    """Save hits as a table bucketed by event, so that per-event groupings of later reads need no shuffle."""
    writer = hits.write.mode("overwrite").format("parquet").bucketBy(buckets, "event_id").sortBy("event_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)
