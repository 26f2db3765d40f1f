"""Array, date, number and payload expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import stripped


def cell_tokens(c: Column, sep: str = ",") -> Column:
    """The trimmed, non-empty parts of a delimited cell; no parts for null. ``sep`` is literal."""
    return F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), rf"\Q{sep}\E"), stripped), lambda t: t != "")


def count_features(c: Column, sep: str = ",") -> Column:
    """How many parts a cell has, repeats counted, null 0."""
    return F.size(cell_tokens(c, sep))


def json_field(c: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON text by its dotted path, as a type; null where it is absent or of another kind."""
    return F.get_json_object(c, f"$.{path}").try_cast(kind)


def join_strings(c: Column, field: str | None = None, sep: str = ",") -> Column:
    """An array (of structs, by one field) as one delimited string."""
    return F.array_join(F.transform(c, lambda x: (x[field] if field else x).cast("string")), sep)


def keys_where_true(c: Column, sep: str = ",") -> Column:
    return F.array_join(F.map_keys(F.map_filter(c, lambda k, v: F.coalesce(v, F.lit(False)))), sep)


def parse_release_date(c: Column) -> Column:
    """'21 Aug, 2012' or 'Aug, 2012' as a timestamp; anything else, 'coming soon' included, is null."""
    text = F.trim(c)
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("d MMM, yyyy")), F.try_to_timestamp(text, F.lit("MMM, yyyy")))
    return F.when(F.lower(text) != "coming soon", parsed)


def parse_date(c: Column) -> Column:
    """An ISO day, or null."""
    return F.to_date(F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-MM-dd")))


def quarter_label(c: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(c).cast("string"))


def days_since(c: Column, reference: Column) -> Column:
    """Whole days from ``c`` to ``reference``, rounded down, as a double."""
    micros = F.unix_micros(reference.cast("timestamp")) - F.unix_micros(c.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("double")


def temporal_features(c: Column, prefix: str, day=True, month=True, year=True, quarter=False, quarter_format="label", days=None) -> dict[str, Column]:
    """The date parts asked for, by column name; a value that is no date gives nulls."""
    t = c.try_cast("timestamp_ntz")
    out = {}
    if day:
        out[f"{prefix}_day"] = F.dayofmonth(t)
    if month:
        out[f"{prefix}_month"] = F.month(t)
    if year:
        out[f"{prefix}_year"] = F.year(t)
    if quarter:
        out[f"{prefix}_quarter"] = quarter_label(t) if quarter_format == "label" else F.quarter(t)
    if days is not None:
        out[f"{prefix}_days_since"] = days_since(t, days)
    return out


def cyclic(c: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of the place in a cycle."""
    angle = c.cast("double") * (2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


LOGS = {"log1p": F.log1p, "log": F.ln, "log10": F.log10}


def shifted(c: Column, least: Column) -> Column:
    """``c`` moved so that its least value becomes 1 where that value is 0 or less."""
    return F.when(least <= 0, c + (1 - least)).otherwise(c)


def ratio(numerator: Column, denominator: Column, transform: str = "log1p", least: Column | None = None, smoothing: float = 1e-9, post_log: bool = True) -> Column:
    """num / (T(den) + smoothing), then log1p of what is above 0."""
    if transform == "log1p":
        den = F.log1p(denominator)
    elif transform == "log":
        den = F.ln(shifted(denominator, least) if least is not None else denominator)
    elif transform == "sqrt":
        den = F.sqrt(F.greatest(denominator, F.lit(0.0)))
    elif transform == "none":
        den = denominator
    else:
        raise ValueError(f"unknown transform {transform!r}")
    r = F.try_divide(numerator.cast("double"), den.cast("double") + F.lit(smoothing))
    return F.log1p(F.when(r.isNotNull(), F.greatest(r, F.lit(0.0)))) if post_log else r


def percent(c: Column, offset: float = 0.0) -> Column:
    """A share in per cent, moved by ``offset`` so that equal lines of a chart stay apart."""
    return c.cast("double") * 100 + F.lit(offset)


def age_years(born: Column, at: Column | None = None) -> Column:
    """Whole years from a day to another, today by default; null where either is missing or the first is later."""
    at = F.current_date() if at is None else at
    return F.when(born <= at, F.floor(F.months_between(at, born) / 12).cast("int"))


def review_tallies(scores: Column) -> dict[str, Column]:
    """``Total_Reviews, Positive_Reviews, Negative_Reviews`` of an array of review scores: above 0 is positive, all else negative; null without reviews."""
    n = F.when(F.size(scores) > 0, F.size(scores))
    good = F.size(F.filter(scores, lambda s: F.coalesce(s, F.lit(0)) > 0))
    return {"Total_Reviews": n, "Positive_Reviews": F.when(n.isNotNull(), good), "Negative_Reviews": n - good}


def success_index(reviews: Column, score: Column) -> Column:
    return F.log1p(reviews.cast("double")) * score
