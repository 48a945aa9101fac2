"""Column expressions on single texts; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stringwright import constants as K


def plain_spaces(value: Column) -> Column:
    """Turn non-breaking spaces into ordinary ones."""
    return F.translate(value, "\u00a0", " ")


def char_ngrams(value: Column, n: int = 3, drop_last: int = 0) -> Column:
    """Distinct character n-grams; ``drop_last=2`` leaves out the final two."""
    last = F.length(value) - (n - 1) - drop_last
    return F.when(
        last >= 1,
        F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(value, i, n))),
    ).otherwise(F.array().cast("array<string>"))


def char_ngrams_between(value: Column, low: int, high: int) -> Column:
    """Distinct character n-grams of every length from ``low`` to ``high``."""
    return F.array_distinct(F.concat(*[char_ngrams(value, n) for n in range(low, high + 1)]))


def gram_codes(grams: Column, n: int) -> Column:
    """N-grams of up to three characters as distinct bigints (21 bits per character), which
    set functions handle in generated code; longer ones stay texts."""
    if n > 3:
        return grams

    def code(g: Column) -> Column:
        parts = [F.ascii(F.substring(g, i + 1, 1)).cast("bigint") * (1 << (21 * (n - 1 - i))) for i in range(n)]
        return sum(parts[1:], parts[0])

    return F.transform(grams, code)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def hash32(text: Column) -> Column:
    """A 32-bit integer from the leading hex digits of an md5, as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash60(text: Column) -> Column:
    """A 60-bit integer from the leading hex digits of an md5, as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def day_code(value: Column) -> Column:
    return F.substring(value, 1, 2)


def to_epoch(value: Column) -> Column:
    """Seconds since 1970 of an ISO or a day-first date."""
    dashed = F.regexp_replace(value, "[/.]", "-")
    return F.unix_timestamp(
        F.coalesce(
            F.try_to_timestamp(value, F.lit("yyyy-MM-dd")),
            F.try_to_timestamp(F.translate(value, "T", " "), F.lit("yyyy-MM-dd HH:mm:ss")),
            F.try_to_timestamp(F.translate(value, "T", " "), F.lit("yyyy-MM-dd HH:mm")),
            F.try_to_timestamp(dashed, F.lit("d-M-yyyy")),
        )
    )


def strip_ends(value: Column, prefix: int, suffix: int) -> Column:
    """Drop a number of characters on both ends."""
    return F.substring(value, F.lit(prefix + 1), F.length(value) - F.lit(prefix + suffix))


def email_words(value: Column) -> Column:
    """``local domain`` without the part of the domain after its first dot."""
    local = F.substring_index(value, "@", 1)
    domain = F.substring(value, F.length(local) + 2, F.length(value))
    return F.when(
        value.contains("@"), F.concat_ws(" ", local, F.substring_index(domain, ".", 1))
    ).otherwise(value)


def path_words(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, "[^a-zA-Z0-9]+", " "))


def url_words(value: Column) -> Column:
    at = F.locate("://", value)
    rest = F.when(at > 0, F.substring(value, at + 3, F.length(value))).otherwise(value)
    return path_words(rest)


def _month_table(index: int) -> Column:
    pairs = [F.lit(x) for name, row in K.MONTHS.items() for x in (name, row[index])]
    return F.create_map(*pairs)


def month_number(value: Column) -> Column:
    """yyMMdd-style number of a month text: month only, month + year or day + month + year."""
    parts = F.filter(F.split(value, r"[,.\-_ ]"), lambda p: p != "")
    word = F.lower(F.regexp_extract(value, "([A-Za-z]{3})", 1))
    month = F.try_element_at(_month_table(0), word)
    days = F.try_element_at(_month_table(1), word)
    numbers = F.filter(parts, lambda p: p.rlike(r"\A\d+\z"))
    quoted = F.regexp_extract(value, r"'(\d+)", 1)

    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))

    def is_year(p: Column) -> Column:
        return (F.length(p) == 4) | (F.coalesce(p.try_cast("int"), F.lit(99)) > days)

    def tail(p: Column) -> Column:
        return F.when(F.length(p) == 4, F.substring(p, 3, 2)).otherwise(p)

    # Each number is a year (four digits, more than the month has days, or after a day) or
    # the day; the last year found counts.
    two_part_year = F.when(quoted != "", quoted).otherwise(tail(first))
    year_first = is_year(first)
    year_second = second.isNotNull() & (is_year(second) | ~year_first)
    year = F.when(year_second, tail(second)).when(year_first, tail(first)).otherwise(quoted)
    day = F.when(~year_first, F.lpad(first, 2, "0")).when(~year_second, F.lpad(second, 2, "0"))
    day = F.coalesce(day, F.lit(""))
    mm = F.lpad(month.cast("string"), 2, "0")
    return (
        F.when(month.isNull(), F.lit(None))
        .when(F.size(parts) == 1, month)
        .when(F.size(parts) == 2, F.concat(two_part_year, mm, F.lit("01")).try_cast("int"))
        .otherwise(F.concat(year, mm, day).try_cast("int"))
    )


# Forms of a numeric text.
RANGE_FORM = r"[0-9]+ ?(?:[-:_/(to)]|to) ?[0-9]+"
COMPARE_FORM = (
    r"(?:[<>$#@%=]+|(?:[Ll]ess|[Ll]ower|[Gg]reater|[Hh]igher) than"
    r"|[Uu]nder|[Bb]elow|[Oo]ver|[Aa]bove)[ \-]?[0-9]+|[0-9]+ ?[<>+$%=]+"
)
LIST_SEPARATOR = " ?[+:;&'] ?"


def range_mean(value: Column) -> Column:
    """Truncated mean of the two ends of a range, null for other texts."""
    ends = F.regexp_extract_all(value, F.lit("([0-9]+)"), 1)
    end = lambda i: F.get(ends, F.lit(i)).try_cast("decimal(37,0)")
    mean = F.floor((end(0) + end(1)) / 2).try_cast("bigint")
    return F.when(value.rlike(rf"\A(?:{RANGE_FORM})\z"), mean)


def compared_number(value: Column) -> Column:
    """The number in texts such as ``<10``, ``over 5``, ``40+`` or ``$100``, else null."""
    return F.when(
        value.rlike(rf"\A(?:{COMPARE_FORM})\z"),
        F.regexp_replace(value, "[^0-9]", "").try_cast("bigint"),
    )


def number_list(value: Column) -> Column:
    """``10+20`` as an array of numbers."""
    return F.transform(F.split(value, LIST_SEPARATOR), lambda p: p.try_cast("bigint"))


def ordinal_number(value: Column) -> Column:
    """``twenty-first``, ``5th`` or ``one hundred and twelfth`` as a number.

    Words are folded left to right: ``hundred`` multiplies the running group, larger
    units close it.
    """
    text = F.lower(value)
    digits = F.regexp_extract(text, r"\A\s*(\d+)\s*(?:st|nd|rd|th)?\s*\z", 1)

    stems = dict(K.IRREGULAR_ORDINALS)
    for word in K.NUMBER_WORDS:
        if word.endswith("y"):
            stems.setdefault(word[:-1] + "ieth", word)
        elif word not in stems.values():
            stems.setdefault(word + "th", word)
    number_of = {**K.NUMBER_WORDS, **{o: K.NUMBER_WORDS[c] for o, c in stems.items()}}
    table = F.create_map(*[F.lit(x) for pair in number_of.items() for x in pair])

    words = F.filter(F.split(text, "[^a-z]+"), lambda w: w.isin(list(number_of)))
    numbers = F.transform(words, lambda w: F.element_at(table, w).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("group"))

    def fold(acc: Column, number: Column) -> Column:
        group = F.greatest(acc["group"], F.lit(1).cast("bigint"))
        return (
            F.when(
                number >= 1000,
                F.struct((acc["done"] + group * number).alias("done"), F.lit(0).cast("bigint").alias("group")),
            )
            .when(number == 100, F.struct(acc["done"].alias("done"), (group * number).alias("group")))
            .otherwise(F.struct(acc["done"].alias("done"), (acc["group"] + number).alias("group")))
        )

    spelled = F.aggregate(numbers, start, fold, lambda acc: acc["done"] + acc["group"])
    return F.when(digits != "", digits.try_cast("bigint")).when(F.size(words) > 0, spelled)


# Letters with a negative sign.
NEGATIVE_LETTERS = ["S", "Z", "W"]


def coordinate_degrees(value: Column) -> Column:
    """Signed decimal degrees of every coordinate in the text, in order (one or two)."""
    letters = F.regexp_extract_all(value, F.lit("([NSZEOW])"), 1)
    dotted = value.rlike(r"\A\s?[NSZEOW]")
    numbers = F.when(dotted, F.regexp_extract_all(value, F.lit(r"(\d+)"), 1)).otherwise(
        F.transform(
            F.regexp_extract_all(value, F.lit(r"(\d+(?:[.,]\d+)?)"), 1),
            lambda x: F.translate(x, ",", "."),
        )
    )

    def degrees(letter: Column, i: Column) -> Column:
        def part(k: int) -> Column:
            return F.get(numbers, i * 3 + k).try_cast("double")

        size = part(0) + part(1) / 60 + part(2) / 3600
        return F.when(letter.isin(NEGATIVE_LETTERS), -size).otherwise(size)

    return F.transform(letters, degrees)


def unit_sphere(lat: Column, lon: Column, in_degrees: bool = True) -> Column:
    """x, y, z on the unit sphere."""
    if in_degrees:
        lat, lon = F.radians(lat), F.radians(lon)
    return F.array(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def zip_key(value: Column) -> Column:
    return F.upper(F.replace(value, F.lit(" "), F.lit("")))
