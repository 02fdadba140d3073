"""Delimited lines that fail to parse, set apart with the reason; the good ones loaded.

Every field is first nullable text; the rules of form and value then each add to an array of
errors, and the rows are split by whether it is empty. All in built-in expressions: one pass, no
Python, however bad the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the file's delimiter while a line is taken apart (a private-use sign).
MARK = "\ue000"
#: A field: blanks and quoted text and blanks, or anything without a quote; possessive, so that long lines cost no stack.
QUOTED = ' *+"[^"]*+(?:""[^"]*+)*+" *+'
FIELD = f'(?:{QUOTED}|[^"{MARK}]*+)'
LINE = f"^{FIELD}(?:{MARK}{FIELD})*+$"
#: What a channel and a treatment look like.
CHANNEL = "^[cC][hH](0?[1-9]|[12][0-9]|3[0-2])$"
DOSE = r"(?=[0-9.]*[1-9])(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+) ?[mu]M [A-Za-z]{2,}"
TREATMENT = rf"^(?:VEH|{DOSE}(?: \+ {DOSE})*+)(?: \([^()]*\))?$"
#: Fixed order of the reasons; a faulty line is given the first that holds.
REASONS = ("quoting", "columns", "channel", "treatment")
NAMES = ("monitor", "channel", "genotype", "sex", "treatment")


def file_delimiters(lines: DataFrame) -> DataFrame:
    """source_file and delimiter, from the header in line 1 of each file."""
    found = F.regexp_extract("raw_line", "^ *Monitor(.)Channel", 1)
    return lines.where((F.col("line_no") == 1) & (found != "")).groupBy("source_file").agg(F.min(found).alias("delimiter"))


def with_delimiters(lines: DataFrame, salts: int = 16) -> DataFrame:
    """Adds each line's delimiter; a file with a third of all lines is spread over ``salts`` tasks."""
    heads = file_delimiters(lines).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lines.withColumn("_salt", F.pmod(F.hash("line_id"), F.lit(salts))).join(heads, ["source_file", "_salt"], "left").drop("_salt")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Every line taken apart: line_id, source_file, line_no, raw_line, the five fields, kind, errors.

    kind is ``header`` (line 1), ``blank`` (null or blanks only), ``empty_channel`` (good channel;
    genotype, sex and treatment ``na``), ``faulty`` (``errors`` names the rules that fail, in the
    order of REASONS) or ``data``. A file without a header has no delimiter: its lines are one
    field each and so fail by ``columns``. Fields of a faulty form are null.
    """
    rows = with_delimiters(lines.select("line_id", "source_file", "line_no", "raw_line"))
    marked = F.coalesce(F.replace("raw_line", F.col("delimiter"), F.lit(MARK)), F.col("raw_line"))
    rows = rows.withColumn("_marked", marked)
    rows = rows.withColumn("_quoting", F.col("_marked").rlike(LINE))
    # the mark within quotes is turned back only after the line is cut at the marks outside them
    fields = F.when(F.col("_quoting"), F.expr("regexp_extract_all(concat('" + MARK + "', _marked), '" + MARK + "(" + FIELD + ")', 1)"))
    rows = rows.withColumn("_fields", fields).withColumn("_five", F.coalesce(F.size("_fields") == 5, F.lit(False)))
    for i, name in enumerate(NAMES):
        rows = rows.withColumn(name, F.when(F.col("_five"), _restored(i)))
    na = [F.lower(F.col(c)) == "na" for c in ("genotype", "sex", "treatment")]
    good_channel = F.col("channel").rlike(CHANNEL)
    rules = [
        (~F.col("_quoting"), "quoting"),
        (F.col("_quoting") & ~F.col("_five"), "columns"),
        (F.col("_five") & ~good_channel, "channel"),
        (F.col("_five") & ~F.col("treatment").rlike(TREATMENT), "treatment"),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
    empty_channel = F.col("_five") & good_channel & na[0] & na[1] & na[2]
    kind = (
        F.when(F.col("line_no") == 1, "header")
        .when(F.col("raw_line").isNull() | F.col("raw_line").rlike("^ *$"), "blank")
        .when(empty_channel, "empty_channel")
        .when(F.size("errors") > 0, "faulty")
        .otherwise("data")
    )
    return rows.withColumn("errors", errors).withColumn("kind", kind).select("line_id", "source_file", "line_no", "raw_line", *NAMES, "kind", "errors")


def _restored(i: int) -> Column:
    """Field i as text: blanks around it off, its quotes off, delimiters inside them back."""
    cell = f"trim(element_at(_fields, {i + 1}))"
    inner = F.replace(F.expr(f"substring({cell}, 2, length({cell}) - 2)"), F.lit('""'), F.lit('"'))
    return F.replace(F.when(F.expr(cell).startswith('"'), inner).otherwise(F.expr(cell)), F.lit(MARK), F.col("delimiter"))


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, faulty): the typed metadata rows; and line_id, source_file, line_no, raw_line, reason, errors."""
    parsed = parsed_lines(lines)
    good = parsed.where(F.col("kind") == "data").select(
        "line_id",
        "source_file",
        "line_no",
        "monitor",
        F.regexp_extract("channel", "([0-9]+)", 1).cast("int").alias("channel"),
        "genotype",
        "sex",
        "treatment",
    )
    faulty = parsed.where(F.col("kind") == "faulty").select("line_id", "source_file", "line_no", "raw_line", F.element_at("errors", 1).alias("reason"), "errors")
    return good, faulty
