"""Numbers in financial prose: value, unit and what marks them, as a struct array column, in built-in functions.

The number pattern's quirks are part of the metric: a number glued to letters or a decimal point is no match, a thousands-grouped
number has no decimals, a sign counts only between currency and digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern's parts and magnitudes.
NUMBER = (
    r"(?iU)(?<![\w.])(\()?\s*(\$|USD\s*|£|GBP\s*|€|EUR\s*)?([+-])?\s*(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"
    r"\s*(\))?\s*(thousand|million|billion|trillion|k|m|bn)?\s*(%|percent\b|percentage points?\b)?(?![\w.])"
)
GROUPS = ("open", "currency", "sign", "number", "close", "magnitude", "percent")
MAGNITUDES = {"thousand": 10**3, "k": 10**3, "million": 10**6, "m": 10**6, "billion": 10**9, "bn": 10**9, "trillion": 10**12}
CURRENCIES = {"$": "USD", "£": "GBP", "€": "EUR"}
VALUE = "decimal(38,10)"


def matches(text: Column) -> Column:
    """array<struct<all, open, currency, sign, number, close, magnitude, percent>>; a part that is not there is empty.

    The text is searched once: every match is written between marks, with its parts behind it, and cut out again. The marks are control characters, which no match has and which the
    pattern treats as any other sign; those of the text become such a sign before."""
    begin, between = "\x01", "\x02"
    marked = F.regexp_replace(F.translate(text, begin + between, "??"), NUMBER, begin + between.join(f"${i}" for i in range(len(GROUPS) + 1)) + begin)
    found = F.transform(F.filter(F.split(marked, begin), lambda x, i: i % 2 == 1), lambda x: F.split(x, between))
    return F.transform(found, lambda p: F.struct(*[F.get(p, i).alias(g) for i, g in enumerate(("all", *GROUPS))]))


def question_unit(question: Column) -> Column:
    """Millions or billions of dollars that a question asks for, as a factor; null if it names neither."""
    q = F.lower(F.coalesce(question, F.lit("")))
    asks = lambda word: q.rlike(rf"(?U)\b(?:usd|us dollars?)\s+{word}s?\b")
    return F.when(asks("million"), F.lit(10**6)).when(asks("billion"), F.lit(10**9))


def numeric_entities(text: Column, question: Column | None = None) -> Column:
    """array<struct<value, unit>> with repeats. Years without a unit and the bare name 3m are none."""
    factor = question_unit(question if question is not None else F.lit(""))

    def entity(m: Column) -> Column:
        value = F.replace(m["number"], F.lit(","), F.lit("")).cast(VALUE)
        value = F.when((m["sign"] == "-") | ((m["open"] != "") & (m["close"] != "")), -value).otherwise(value)
        size = F.lower(m["magnitude"])
        times = F.lit(1).cast("decimal(14,0)")
        for name, n in MAGNITUDES.items():
            times = F.when(size == name, F.lit(n).cast("decimal(14,0)")).otherwise(times)
        mark = F.regexp_replace(m["currency"], r"\s+", "")
        currency = F.upper(mark)
        for sign, name in CURRENCIES.items():
            currency = F.when(mark == sign, F.lit(name)).otherwise(currency)
        unit = (
            F.when(m["percent"] != "", F.when(F.lower(m["percent"]).isin("%", "percent"), F.lit("percent")).otherwise(F.lit("percentage_points")))
            .when(m["currency"] != "", currency)
            .when(factor.isNotNull(), F.lit("USD"))
            .otherwise(F.lit("number"))
        )
        asked = (m["percent"] == "") & (size == "") & factor.isNotNull() & (unit == "USD")
        times = F.when(asked, factor.cast("decimal(14,0)")).otherwise(times)
        return F.struct((value * times).cast(VALUE).alias("value"), unit.alias("unit"))

    def counts(m: Column) -> Column:
        value = F.replace(m["number"], F.lit(","), F.lit("")).cast(VALUE)
        year = (value == F.floor(value)) & value.between(1900, 2100) & (m["magnitude"] == "") & (m["percent"] == "") & (m["currency"] == "")
        return (F.lower(F.regexp_replace(m["all"], r"(?U)^\s+|\s+\z", "")) != "3m") & ~year

    return F.transform(F.filter(matches(text), counts), entity)


def rounded(x: Column, digits: int) -> Column:
    """round() that keeps the sign of what becomes zero, as floating-point arithmetic has it; Spark's own goes through decimals, which have no negative zero."""
    r = F.round(x, digits)
    return F.when(r == 0, x * F.lit(0.0)).otherwise(r)


def exact_mean(x: Column) -> Column:
    """Mean of a group, the same in whatever order its rows are added: by a sum of decimals where all its values have twelve decimal places at most (and fifteen digits before them), else avg()."""
    d = x.try_cast("decimal(27,12)")
    alike = F.count(F.when(d.cast("double") == x, 1)) == F.count(x)
    return F.when(alike, F.sum(d).cast("double") / F.count(x)).otherwise(F.avg(x))


def financial_spans(text: Column) -> Column:
    """array<string>: numbers with a currency, magnitude or percent mark; 3m or 5k without a currency is a name."""
    def financial(m: Column) -> Column:
        glued = F.lower(m["magnitude"]).isin("m", "k") & (m["currency"] == "") & F.contains(F.lower(m["all"]), F.lower(F.concat(m["number"], m["magnitude"])))
        return ((m["currency"] != "") | (m["magnitude"] != "") | (m["percent"] != "")) & ~glued

    return F.transform(F.filter(matches(text), financial), lambda m: F.regexp_replace(m["all"], r"(?U)^\s+|\s+\z", ""))


def number_keys(text: Column) -> Column:
    """Distinct digit strings of all numbers."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(4)), lambda n: F.regexp_replace(n, "[^0-9]", "")))
