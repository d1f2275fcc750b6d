"""Labels, days, keys and status ladders as Column functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.pricing import first_reason

EASTERN = "America/New_York"
DIACRITICS = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN_LETTERS = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def eastern_day(at_ms: Column) -> Column:
    """The calendar day in New York of an instant in epoch milliseconds."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(EASTERN), F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=at_ms / 1000)))


def folded(label: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def searchable(label: Column) -> Column:
    return folded(F.translate(label, DIACRITICS, PLAIN_LETTERS))


def composed(df: DataFrame, label: str) -> DataFrame:
    """df with the label in compatibility composition (NFKC): full-width and decomposed letters as plain ones.

    ASCII labels are so already and never leave the JVM; of the others each distinct one goes to Python once, in Arrow
    batches, and comes back by a join that adaptive execution broadcasts if it is small. Null stays null.
    """
    other = F.octet_length(label) > F.char_length(label)

    def of(labels: pa.Array) -> pa.Array:
        return pa.array([unicodedata.normalize("NFKC", x) for x in labels.to_pylist()], pa.string())

    found = df.where(other).select(F.col(label).alias("__label")).distinct().select("__label", F.arrow_udf(of, "string")("__label").alias("__composed"))
    both = df.join(found, F.when(F.octet_length(df[label]) > F.char_length(df[label]), df[label]) == F.col("__label"), "left")
    return both.withColumn(label, F.coalesce("__composed", label)).drop("__label", "__composed")


def book_id(book: Column) -> Column:
    return F.lower(F.trim(book))


def words_match(left: Column, right: Column) -> Column:
    """labels_match for labels that are folded already."""
    a, b = F.split(left, " "), F.split(right, " ")
    shorter = F.when(F.size(a) <= F.size(b), F.size(F.array_except(a, b))).otherwise(F.size(F.array_except(b, a)))
    return (left != "") & (right != "") & ((left == right) | ((F.substring_index(left, " ", -1) == F.substring_index(right, " ", -1)) & (shorter == 0)))


def labels_match(left: Column, right: Column) -> Column:
    """Equal after folding, or the same last word and the shorter one's words all in the longer one; empty labels match nothing."""
    return words_match(folded(left), folded(right))


def words_within(whole: Column, given: Column) -> Column:
    """Whether a folded label is the whole one or an abbreviation of it: all of its words in it, and the same last word."""
    ends = F.substring_index(whole, " ", -1) == F.substring_index(given, " ", -1)
    return (given != "") & ((whole == given) | (ends & (F.size(F.array_except(F.split(given, " "), F.split(whole, " "))) == 0)))


#: Fixed value: club words that tell no two participants apart.
GENERIC_WORDS = ("afc", "cf", "city", "club", "fc", "fk", "gnk", "pfc", "sc", "sk", "united")
#: Fixed value: letters that have no decomposition, and how they are written out.
WRITTEN_OUT = (("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("æ", "ae"), ("œ", "oe"))


def plain_words(label: Column) -> Column:
    """The label's words in plain a-z and 0-9, for Latin letters with the usual accents."""
    text = F.lower(F.translate(label, DIACRITICS, PLAIN_LETTERS))
    for letter, written in WRITTEN_OUT:
        text = F.replace(text, F.lit(letter), F.lit(written))
    text = F.when(F.octet_length(label) == F.char_length(label), F.lower(label)).otherwise(text)
    return F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1)


def fuzzy_match(left: Column, right: Column) -> Column:
    """Equal without blanks; one contains the other (4 letters or more); the same words but for generic ones; or a shared
    word of 4 letters or more that isn't generic."""
    return fuzzy_parts_match(fuzzy_parts(left), fuzzy_parts(right))


def telling_words(words: Column) -> Column:
    """The words that aren't generic, each once, in order."""
    return F.sort_array(F.array_except(words, F.array(*map(F.lit, GENERIC_WORDS))))


def long_words(words: Column) -> Column:
    return F.filter(words, lambda w: F.length(w) >= 4)


def fuzzy_parts(label: Column) -> Column:
    """What fuzzy_match compares of a label, to be computed before a join."""
    words = plain_words(label)
    own = telling_words(words)
    return F.struct(F.array_join(words, "").alias("whole"), own.alias("own"), long_words(own).alias("long"))


def fuzzy_parts_match(a: Column, b: Column) -> Column:
    contains = (F.least(F.length(a["whole"]), F.length(b["whole"])) >= 4) & (F.contains(a["whole"], b["whole"]) | F.contains(b["whole"], a["whole"]))
    return (a["whole"] == b["whole"]) | contains | ((F.size(a["own"]) > 0) & (a["own"] == b["own"])) | F.arrays_overlap(a["long"], b["own"])


def selection_key(participant: Column, side: Column | None = None) -> Column:
    """participant: and the percent-encoded id, with :over or :under if a side is given."""
    key = F.concat(F.lit("participant:"), F.replace(F.url_encode(participant), F.lit("+"), F.lit("%20")))
    return key if side is None else F.when(side.isNull(), key).otherwise(F.concat(key, F.lit(":"), side))


def connection_state(outage: Column, checked_age_s: Column, failed: Column, stale_after_s: int) -> Column:
    return F.coalesce(
        first_reason(
            (outage, "outage"), (checked_age_s.isNull(), "unknown"), (checked_age_s > stale_after_s, "stale"), (failed > 0, "partial")
        ),
        F.lit("healthy"),
    )


def capacity_state(remaining: Column, reserve: Column) -> Column:
    return F.coalesce(
        first_reason(
            (remaining.isNull() | (remaining < 0), "unknown"), (remaining == 0, "exhausted"), (remaining <= reserve, "reserve-protected"), (remaining <= 2 * reserve, "low")
        ),
        F.lit("available"),
    )


def impact(capability: Column, connection: Column, capacity: Column) -> Column:
    """Prices that can't be trusted suppress recommendations; other troubles limit them."""
    odds, other = capability == "odds", capability.isin("account", "schedule")
    return (
        F.when(odds & connection.isin("outage", "unknown", "stale"), "suppressed")
        .when((odds & (connection == "partial")) | (other & (connection != "healthy")) | capacity.isin("reserve-protected", "exhausted"), "limited")
        .otherwise("none")
    )


def metadata_freshness(at_ms: Column, now_ms: Column, most_s: int = 7200) -> Column:
    """current, stale, or unavailable if the instant is missing or in the future."""
    return F.when(at_ms.isNull() | (at_ms > now_ms), "unavailable").when(now_ms - at_ms <= most_s * 1000, "current").otherwise("stale")


def metadata_availability(status: Column, at_ms: Column, now_ms: Column) -> Column:
    """unavailable without usable evidence, else complete, or partial if the status is unknown."""
    return F.when(metadata_freshness(at_ms, now_ms) == "unavailable", "unavailable").when(status != "unknown", "complete").otherwise("partial")


def split_cell(bet_percent: Column, money_percent: Column) -> Column:
    """Percents held to 0..100 and their divergence."""
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return F.struct(
        held(bet_percent).alias("bet"), held(money_percent).alias("money"), F.round(held(money_percent) - held(bet_percent), 9).alias("divergence")
    )


def content_id(domain: str, *columns: str) -> Column:
    """SHA-256 of the columns' JSON under their names in order, with a domain prefix; equal content, equal id."""
    return F.sha2(F.concat(F.lit(f"{domain}\n"), F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})), 256)
