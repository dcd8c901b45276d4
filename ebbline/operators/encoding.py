"""Label, yes/no and category encoding."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline import schema
from ebbline.functions.expressions import flag
from ebbline.operators.ordered import global_positions
from ebbline.operators.profiling import is_text
from ebbline.sources.staging import attach, stage

# A column with at most this many values is encoded by a CASE; others by a join.
CASE_VALUES = 64


def encode_label(df: DataFrame, label: str = schema.LABEL, positive: str = "Yes") -> DataFrame:
    """1 for the positive text, 0 for anything else (F1)."""
    return df.withColumn(label, flag(F.col(label) == positive))


def yes_no(column: Column) -> Column:
    return F.when(column == "Yes", 1).when(column == "No", 0)


def encode_label_strict(df: DataFrame, label: str = schema.LABEL) -> DataFrame:
    """Yes to 1, No to 0, other texts to null (F2)."""
    return df.withColumn(label, yes_no(F.col(label)))


def encode_binary(
    df: DataFrame, columns: list[str] | None = None, strict: bool = False
) -> DataFrame:
    """Textual yes/no columns to 1/0; other texts to 0, or to null if strict."""
    columns = columns or [*schema.BINARY_COLUMNS, "SeniorCitizen"]
    texts = [c for c in columns if is_text(df, c)]
    coded = {c: yes_no(F.col(c)) if strict else flag(F.col(c) == "Yes") for c in texts}
    return df.withColumns(coded) if coded else df


def _as_category(column: Column) -> Column:
    # A missing category is a category of its own, written as the text below.
    return F.coalesce(column.cast("string"), F.lit("nan"))


def fit_encoders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Code table ``column_name, value, code``: code = place in sorted order."""
    columns = columns or [c for c in schema.CATEGORY_COLUMNS if c in df.columns]
    texts = df.select(*[_as_category(F.col(c)).alias(c) for c in columns])
    vocabulary = texts.unpivot([], columns, "column_name", "value").distinct()
    vocabulary = stage(vocabulary, "vocabulary")
    placed = global_positions(vocabulary, ["column_name", "value"])
    starts = placed.groupBy("column_name").agg(F.min("position").alias("start"))
    # One row per encoded column.
    coded = placed.join(F.broadcast(starts), "column_name")
    return coded.select(
        "column_name", "value", (F.col("position") - F.col("start")).cast("int").alias("code")
    )


def encoder_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Listing of the codes."""
    return fit_encoders(df, columns)


def _finish(code: Column, name: str, text: Column, unseen: str) -> Column:
    if unseen == "zero":
        return F.coalesce(code, F.lit(0))
    message = F.concat(F.lit(f"unseen value in {name}: "), text)
    return F.coalesce(code, F.raise_error(message).cast("int"))


def look_up(df: DataFrame, codes: DataFrame, columns: list[str], unseen: str = "error") -> DataFrame:
    """Replace categories by their codes in a staged code table of any size.

    A table that fits a broadcast moves no row. Beyond that, values that many rows share (a missing
    category, say) are broadcast all the same, and only the rows of the others are shuffled.
    """
    out = df
    for c in columns:
        lookup = codes.where(F.col("column_name") == c).select(F.col("value").alias("_text"), F.col("code").alias("_code"))
        keyed = out.withColumn("_text", _as_category(F.col(c)))
        # A stream's rows can't be counted: the planner decides by the table's size.
        joined = keyed.join(lookup, "_text", "left") if df.isStreaming else attach(keyed, lookup, ["_text"], "left")
        out = joined.withColumn(c, _finish(F.col("_code"), c, F.col("_text"), unseen)).drop("_text", "_code")
    return out


def apply_encoders(
    df: DataFrame,
    codes: DataFrame,
    columns: list[str] | None = None,
    unseen: str = "error",
) -> DataFrame:
    """Replace categories by their codes; an unseen one fails or becomes code 0.

    Vocabularies of up to ``CASE_VALUES`` turn into CASE expressions: no join, no shuffle. Larger
    ones stay a table; see ``look_up``.
    """
    codes = stage(codes, "codes")
    sizes = {r[0]: r[1] for r in codes.groupBy("column_name").count().collect()}
    columns = [c for c in (columns or sorted(sizes)) if c in sizes and c in df.columns]
    short = [c for c in columns if sizes[c] <= CASE_VALUES]
    pairs = codes.where(F.col("column_name").isin(short)).collect() if short else []
    coded = {}
    for c in short:
        text = _as_category(F.col(c))
        code = F.lit(None).cast("int")
        for row in sorted((r for r in pairs if r["column_name"] == c), key=lambda r: -r["code"]):
            code = F.when(text == row["value"], row["code"]).otherwise(code)
        coded[c] = _finish(code, c, text, unseen)
    out = df.withColumns(coded) if coded else df
    return look_up(out, codes, [c for c in columns if c not in short], unseen).select(*df.columns)


def apply_encoders_lenient(
    df: DataFrame, codes: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Scoring form: an unseen category becomes code 0."""
    return apply_encoders(df, codes, columns, unseen="zero")
