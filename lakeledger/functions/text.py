"""String formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a title keeps in lower case unless they come first.
SMALL_WORDS = ("a", "and", "are", "as", "at", "but", "by", "for", "from", "if", "in", "into", "is", "not", "of", "on",
               "or", "per", "so", "than", "that", "the", "via", "with")


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def title_case(text: Column) -> Column:
    """Capitalise each word; small words after the first stay lower case."""
    words = F.split(text, " ")

    def shape(word, i):
        small = word.isin(*SMALL_WORDS)
        raised = F.concat(F.upper(F.left(word, F.lit(1))), F.substr(word, F.lit(2)))
        return F.when((i > 0) & small, word).otherwise(raised)

    return F.array_join(F.transform(words, shape), " ")


def layer_name(state: Column, fips: Column, resolution: str = "M") -> Column:
    return F.format_string(f"NHD_{resolution}_%s_%s_ST", fips, F.replace(state, F.lit(" "), F.lit("_")))


def two_decimals(number: Column) -> Column:
    """At most two decimals, halves to even, without trailing zeros: 2, 2.5, 2.25."""
    return F.regexp_replace(F.format_string("%.2f", F.bround(number, 2)), r"\.?0+$", "")


def interval_text(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), two_decimals(low), F.lit(", "), two_decimals(high), F.lit("]"))


def count_label(name: Column, count: Column, plain: bool = False) -> Column:
    """``name\\n (n=1,234)``, or ``name\\n (1234)`` in the plain style."""
    if plain:
        return F.concat(name, F.lit("\n ("), count.cast("string"), F.lit(")"))
    return F.concat(name, F.lit("\n (n="), F.format_number(count, 0), F.lit(")"))
