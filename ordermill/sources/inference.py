"""Column types out of CSV text, with an account of what decided them.

Every cell belongs to the narrowest kind that takes its text without loss: a number with leading
zeros is text, as a code is. Kinds form a lattice; a column gets the narrowest type that all its
cells fit. A first scan of all rows takes every cell as a row of its own and counts kinds and digits
by column: one short piece of code whatever the number of columns, and tasks pass on a row per column
and kind. A second scan finds the cell that widened a type, for the columns that have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermill.sources.files import CheckedCsv, read_checked_csv

# kinds from narrow to wide within numbers and times; the first is no kind of its own
KINDS = ("boolean", "int", "bigint", "decimal", "double", "date", "timestamp", "string")
_NUMBERS = ("int", "bigint", "decimal", "double")
_NUMBER = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?$"
_EXPONENT = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?[eE][+-]?[0-9]+$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"
_MOST_DIGITS = 38


def _digits(text: Column) -> tuple[Column, Column]:
    """Digits of a number before and after the point."""
    signs = F.when(F.substring(text, 1, 1).isin("+", "-"), 1).otherwise(0)
    whole = F.length(F.substring_index(text, ".", 1)) - signs
    return whole, F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(0)


def kind_of(text: Column) -> Column:
    """The kind of one cell; null for an absent one.

    No text fits the form of two kinds, so each form is matched at most once.
    """
    whole, scale = _digits(text)
    point = F.contains(text, F.lit("."))
    number = (
        F.when(~point & text.try_cast("int").isNotNull(), "int")
        .when(~point & text.try_cast("bigint").isNotNull(), "bigint")
        .when(whole + scale <= _MOST_DIGITS, "decimal")
        .otherwise("string")
    )
    dated = F.substring(text, 5, 1) == "-"
    return (
        F.when(text.isNull(), F.lit(None))
        .when(text.rlike(_NUMBER), number)
        .when(dated & text.rlike(_DATE) & text.try_cast("date").isNotNull(), "date")
        .when(dated & text.rlike(_TIME) & text.try_cast("timestamp").isNotNull(), "timestamp")
        .when(F.lower(text).isin("true", "false"), "boolean")
        .when(text.rlike(_EXPONENT) & text.try_cast("double").isNotNull(), "double")
        .otherwise("string")
    )


def narrowest(kinds: set[str], whole: int, scale: int) -> tuple[str, str | None]:
    """(type, the kind that widened it): the least type that takes all the kinds."""
    if not kinds:
        return "string", None
    if len(kinds) == 1 and kinds != {"decimal"}:
        return next(iter(kinds)), None
    if kinds <= set(_NUMBERS):
        widest = max(kinds, key=_NUMBERS.index)
        if widest == "decimal":
            if whole + scale > _MOST_DIGITS:
                return "string", "decimal"
            return f"decimal({max(whole + scale, 1)},{scale})", "decimal" if len(kinds) > 1 else None
        if widest == "double" and whole + scale > 15:
            # a double would round some of the other cells
            return "string", "double"
        return widest, widest
    if kinds <= {"date", "timestamp"}:
        return "timestamp", "timestamp"
    # the kind that none of the others shares a type with
    return "string", "string" if "string" in kinds else max(kinds, key=KINDS.index)


def inferred_types(text: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Per column: data_type, cells of each kind, and the kind and the cell that widened the type.

    A row per column and kind of one table leaves the cluster. The cell is the least text of its kind.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{n}`").alias("cell")) for i, n in enumerate(columns)])
    cell = F.col("cell")
    whole, scale = _digits(cell)
    found = (
        text.select(F.inline(cells))
        .filter(cell.isNotNull())
        .select("i", kind_of(cell).alias("kind"), whole.alias("whole"), scale.alias("scale"))
        .groupBy("i", "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"), F.max("scale").alias("scale"))
        .collect()
    )
    decided = []
    for i in range(len(columns)):
        own = sorted((r for r in found if r.i == i), key=lambda r: KINDS.index(r.kind))
        digits = [(r.whole, r.scale) for r in own if r.kind in _NUMBERS[:3]] or [(0, 0)]
        counts = {r.kind: r.n for r in own}
        decided.append((counts, *narrowest(set(counts), *map(max, zip(*digits, strict=True)))))
    widening = {i: F.col(f"`{columns[i]}`") for i, (_, _, widened) in enumerate(decided) if widened}
    examples = {}
    if widening:
        least = [F.min(F.when(kind_of(c) == decided[i][2], c)) for i, c in widening.items()]
        examples = dict(zip(widening, text.agg(*least).first(), strict=True))
    rows = [
        (table, name, kind, counts, widened, examples.get(i))
        for i, (name, (counts, kind, widened)) in enumerate(zip(columns, decided, strict=True))
    ]
    return text.sparkSession.createDataFrame(
        rows,
        "table_name string, column_name string, data_type string, cells map<string,bigint>, "
        "widened_by string, widening_cell string",
    )


def read_inferred_csv(spark: SparkSession, path: str, table: str) -> tuple[CheckedCsv, DataFrame]:
    """CSV as text with the inferred types, so that broken lines are kept; and the account."""
    header = spark.read.option("header", True).csv(path).columns
    as_text = T.StructType([T.StructField(h.strip(), T.StringType()) for h in header])
    read = read_checked_csv(spark, path, as_text)
    account = inferred_types(read.text.filter(~read.broken()), as_text.names, table)
    types = {r.column_name: r.data_type for r in account.collect()}
    schema = T.StructType(
        [T.StructField(n, T._parse_datatype_string(types[n])) for n in as_text.names]
    )
    return CheckedCsv(read.text, schema), account
