"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without its last suffix (STR01)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column | str) -> Column:
    return F.get(F.reverse(F.split(_c(path), "/")), F.lit(1))


def relative_to(path: Column | str, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(_c(path), F.lit(root)), F.substring(_c(path), F.lit(len(root) + 1), F.length(_c(path))))


def take(text: Column | str, sep: str, index: int) -> Column:
    """One part of a split (STR02)."""
    return F.get(F.split(_c(text), sep), F.lit(index))


def after_first(text: Column | str, sep: str) -> Column:
    """All parts but the first, joined again (STR02)."""
    p = F.split(_c(text), sep)
    return F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), sep)


def is_header(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit("^[a-z0-9_]+$"))


def is_sha1(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit("^[a-f0-9]{40}$"))


def is_alphanumeric(text: Column | str) -> Column:
    return F.rlike(_c(text), F.lit("^[a-zA-Z0-9]+$"))


def padded(number: Column | str, width: int = 2) -> Column:
    """Zero-padded (STR04); longer numbers are not cut."""
    t = _c(number).cast("string")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def template(pattern: str, **columns: Column | str) -> Column:
    """``{name}`` in the pattern replaced by columns (STR04)."""
    parts, rest = [], pattern
    while "{" in rest:
        before, _, more = rest.partition("{")
        name, _, rest = more.partition("}")
        parts += [F.lit(before), _c(columns[name]).cast("string")]
    return F.concat(*parts, F.lit(rest))


def url_part(url: Column | str, part: str) -> Column:
    """HOST, PATH, QUERY, PROTOCOL ... of a URL (STR05); null where it is none."""
    return F.try_parse_url(_c(url), F.lit(part))


def hemisphere(text: Column | str) -> Column:
    """lh or rh (STR06); anything else is an error."""
    t = F.lower(_c(text))
    return F.when(t.isin("left", "l", "lh"), "lh").when(t.isin("right", "r", "rh"), "rh").otherwise(F.raise_error(F.concat(F.lit("no hemisphere: "), F.coalesce(t, F.lit("null")))))


def without_prefix(text: Column | str, prefix: str) -> Column:
    """STR07."""
    return F.when(F.startswith(_c(text), F.lit(prefix)), F.substring(_c(text), F.lit(len(prefix) + 1), F.length(_c(text)))).otherwise(_c(text))


def round_even(x: Column | str, digits: int = 0) -> Column:
    """Halves go to the even digit (MTH01)."""
    return F.bround(_c(x), digits)


def projection_limit(n: Column | int, epsilon: float = 0.1) -> Column:
    """Dimensions that keep all distances of n points within epsilon (MTH02)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.ceil(4 * F.ln(n) / F.lit(epsilon**2 / 2 - epsilon**3 / 3)).cast("long")


def onset_ms(sample: Column | str) -> Column:
    """First millisecond of a sample at 250 Hz, samples counted from 1 (MTH03)."""
    return (_c(sample) * 4 - 3).cast("long")


def samples_of(ms: Column | str, rate: float) -> Column:
    return F.bround(_c(ms) * F.lit(rate / 1000.0)).cast("long")


def rescaled(value: Column | str, scale: str | float, spread: Column | None = None) -> Column:
    """``original`` (micro-units), ``std`` (over a spread), or over a number (MTH04)."""
    if scale == "original":
        return _c(value) * 1e6
    if scale == "std":
        return _c(value) / F.nullif(spread, F.lit(0.0))
    return _c(value) / F.lit(float(scale))


def recode(value: Column | str, low, high, threshold: float = 0.0) -> Column:
    """Below the threshold ``low``, otherwise ``high``; NaN and null stay (MTH05)."""
    v = _c(value).cast("double")
    return F.when(F.isnan(v) | v.isNull(), v).when(v < threshold, F.lit(low)).otherwise(F.lit(high))


def dot(a: Column | str, b: Column | str) -> Column:
    """MTH06."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def flat(array: Column | str) -> Column:
    """ARR01."""
    return F.flatten(_c(array))


def json_field(text: Column | str, path: str, kind: str = "string") -> Column:
    """JSN01; null where there is no such field or no JSON."""
    return F.get_json_object(_c(text), path).try_cast(kind)


def sha1(content: Column | str) -> Column:
    """HSH01."""
    return F.sha1(_c(content))


def mapped(column: Column | str, mapping: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(column))
