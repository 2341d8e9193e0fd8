"""Scalar functions on urls, names, messages, times and article texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are taken off.
SUFFIXES = [" Inc.", " Corp.", " Corporation", " Ltd.", " LLC", ","]
#: Parts of a message in lower case, its code and its kind; the first that fits counts.
ERRORS = [
    (("429", "too many requests"), "429", None),
    (("403", "forbidden"), "403", "HTTP 403 Forbidden"),
    (("404", "not found"), "404", "HTTP 404 Not Found"),
    (("500", "internal server error"), "500", "HTTP 500 Internal Server Error"),
    (("502", "bad gateway"), "502", "HTTP 502 Bad Gateway"),
    (("503", "service unavailable"), "503", "HTTP 503 Service Unavailable"),
    (("timeout", "timed out"), "TIMEOUT", "Connection Timeout"),
    (("connection",), "CONN_ERR", "Connection Error"),
    (("ssl", "certificate"), "SSL_ERR", "SSL/Certificate Error"),
]
RATE_LIMITED, UNKNOWN = "429", "Unknown Error"
#: What of a link is a handle, without regard to case, and what a link of another use holds, with regard to it.
PLATFORMS = {
    "twitter": r"twitter\.com/([a-zA-Z0-9_]+)",
    "facebook": r"facebook\.com/([a-zA-Z0-9\.]+)",
    "linkedin": r"linkedin\.com/company/([a-zA-Z0-9-]+)",
    "instagram": r"instagram\.com/([a-zA-Z0-9_\.]+)",
    "youtube": r"youtube\.com/(?:user/|c/|channel/|@)([a-zA-Z0-9_-]+)",
}
OTHER_USE = ["share", "intent"]
LINK = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
#: Words of market news, as the default scorer has them.
POSITIVE = "beat beats boost exceed exceeded expand gain gains good growth higher improve improved outperform profit profitable raise raised rally rebound record rise rises robust soar strong strength success surge upgrade upside win".split()
NEGATIVE = "bad bankruptcy cut cuts decline declined default downgrade drop fall falls fear fraud investigation lawsuit layoffs loss losses lower miss missed plunge probe recall recession risk sink slump tumble underperform warning weak weakness worse".split()


def domain(url: Column) -> Column:
    """Authority without any "www."; empty where there is no "//"."""
    return F.replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("www."), F.lit(""))


def phrase(name: Column) -> Column:
    for x in SUFFIXES:
        name = F.replace(name, F.lit(x), F.lit(""))
    return F.concat(F.lit('"'), name, F.lit('" AND language:en'))


def ticker(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("."), F.lit("-"))


def file_name(x: Column) -> Column:
    return F.translate(x, "/\\", "__")


def error_class(message: Column) -> Column:
    """code (else the first number of three digits, or null) and kind (null for a rate limit)."""
    number = F.regexp_extract(message, r"\b(\d{3})\b", 1)
    code, kind = F.when(number != "", number), F.lit(UNKNOWN)
    for parts, its_code, its_kind in reversed(ERRORS):
        fits = F.lit(False)
        for x in parts:
            fits = fits | F.lower(message).contains(x)
        code, kind = F.when(fits, its_code).otherwise(code), F.when(fits, F.lit(its_kind)).otherwise(kind)
    return F.struct(code.alias("code"), kind.alias("kind"))


def shortened(message: Column, n: int = 500) -> Column:
    return F.substring(message, 1, n)


def model_text(title: Column, content: Column, n: int = 2000) -> Column:
    return F.substring(F.concat_ws(" ", title, F.when(F.trim(content) != "", content)), 1, n)


def handles(html: Column) -> Column:
    """Platform to handles, of the links that neither share nor intend a post, each once, in order."""
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    links = F.filter(links, lambda x: ~reduce(or_, map(x.contains, OTHER_USE)))

    def of(own: Column, pattern: str) -> Column:
        return F.array_distinct(F.filter(F.transform(own, lambda x: F.regexp_extract(x, f"(?i){pattern}", 1)), lambda x: x != ""))

    def found(own: Column) -> Column:
        return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, PLATFORMS)), F.array(*[of(own, p) for p in PLATFORMS.values()])), lambda _, v: F.size(v) > 0)

    # a list of one, so that links are found once and not once for each platform
    return F.transform(F.array(links), found)[0]


def handles_json(found: Column) -> Column:
    return F.to_json(found)


def handles_of_json(text: Column) -> Column:
    return F.from_json(text, "map<string, array<string>>")


def epoch_text(seconds: Column) -> Column:
    """As "2024-01-31 12:00:00", in UTC; years after 9999 have more digits, and no sign."""
    return F.regexp_replace(F.timestamp_seconds(F.floor(seconds)).cast("string"), r"^\+", "")


def time_or_null(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def significance(p: Column, otherwise: str, level: float = 0.05) -> Column:
    return F.when(p < level, "Significant").otherwise(otherwise)


def lexicon_sentiment(text: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> tuple[Column, Column]:
    """Shares of the words that stand in the positive and in the negative list: what stands in for a model."""
    words = F.split(F.lower(text), r"[^a-z]+")
    share = lambda own: F.size(F.filter(words, lambda w: w.isin(own))) / F.greatest(F.lit(1), F.size(words))
    return share(positive), share(negative)
