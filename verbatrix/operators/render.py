"""Table records as prose, for scorers that expect sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Longer renderings are cut.
MOST_CHARS = 1800
#: Lines with one of these are not records.
NOT_RECORDS = ("(continued)", "(continued from", "(column headers unresolved)")
UNIT = r"(?i)\A(?:(?:USD\s+)?(?:thousand|million|billion|trillion)s?|percent|USD)\z"


def decapitalized(text: Column) -> Column:
    """First letter in lower case, unless the second is upper case."""
    acronym = (F.length(text) > 1) & F.substring(text, 2, 1).rlike(r"\p{Lu}")
    return F.when(acronym, text).otherwise(F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))


def rendered_value(value: Column, unit: Column) -> Column:
    """Value with its unit: "$5 million", "5 percent", "5 million"."""
    one = F.regexp_replace(T.strip(unit), r"(?i)\b(thousand|million|billion|trillion)s\b", "$1")
    dollars = F.upper(one).startswith("USD ")
    return (
        F.when(F.coalesce(unit, F.lit("")) == "", value)
        .when(F.lower(one) == "percent", F.concat(value, F.lit(" percent")))
        .when(F.upper(one) == "USD", F.concat(F.lit("$"), value))
        .when(dollars, F.concat(F.lit("$"), value, F.lit(" "), F.substring(one, F.lit(5), F.length(one))))
        .otherwise(F.concat(value, F.lit(" "), one))
    )


def rendered_record(line: Column) -> Column:
    """ "A | B | C | 21.7 | millions" becomes "A, b, c: 21.7 million"; other lines are only joined by commas."""

    def by_fields(fields: Column) -> Column:
        n = F.size(fields)
        other = F.lit(False)
        for marker in NOT_RECORDS:
            other = other | line.contains(marker)
        has_unit = F.element_at(fields, -1).rlike(UNIT)
        unit = F.when(has_unit, F.element_at(fields, -1)).otherwise(F.lit(""))
        rest = F.when(has_unit, F.slice(fields, 1, n - 1)).otherwise(fields)

        def with_value(f: Column) -> Column:
            value = F.element_at(f, -1)
            context = F.concat(F.slice(f, 1, 1), F.transform(F.slice(f, 2, F.greatest(F.size(f) - 2, F.lit(0))), decapitalized))
            return F.when(F.size(f) == 1, rendered_value(value, unit)).otherwise(F.concat(F.array_join(context, ", "), F.lit(": "), rendered_value(value, unit)))

        return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(fields, 1)).when(other, F.array_join(fields, ", ")).otherwise(T.let(rest, with_value))

    return T.let(F.filter(F.transform(F.split(line, r" \| ", -1), T.strip), lambda f: f != ""), by_fields)


def rendered_chunk(text: Column) -> Column:
    """All records of a chunk as one run of prose."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\s]"))
    return F.substring(F.array_join(F.filter(F.transform(lines, rendered_record), lambda r: r != ""), " "), 1, MOST_CHARS)


def scoring_text(text: Column, kind: Column) -> Column:
    """What a scorer is shown: records as prose, anything else as it is."""
    return F.when(kind == "table_records", rendered_chunk(text)).otherwise(text)


def render_stats(chunks: DataFrame) -> DataFrame:
    """How many chunks are rendered, of how many records, and how many of them are cut."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\s]"))
    made = chunks.filter("kind = 'table_records'").select(F.filter(F.transform(lines, rendered_record), lambda r: r != "").alias("r"))
    return made.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.size("r")), F.lit(0)).alias("records"), F.count_if(F.length(F.array_join("r", " ")) > MOST_CHARS).alias("truncated"))
