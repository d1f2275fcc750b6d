"""Provider pages: nested JSON taken apart element by element, so that a bad element is quarantined and its siblings stay.

A page is parsed once, as a variant; its elements are exploded as variants, and each field is read with the kind of value
that it must have. What a page must be (an envelope) and what an element must be (a list of rules) are data, a kind each.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.functions.pricing import first_reason, issues

MOST_ELEMENTS = 200


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def text(value: Column, path: str, most: int = 256) -> Column:
    """A string that is trimmed, not empty and of `most` characters at most, else null."""
    found = F.try_variant_get(value, path, "string")
    return F.when((_kind(value, path) == "STRING") & (found != "") & (found == F.trim(found)) & (F.char_length(found) <= most), found)


def whole(value: Column, path: str) -> Column:
    """A whole number from 0 on, else null."""
    found = F.try_variant_get(value, path, "bigint")
    return F.when((_kind(value, path) == "BIGINT") & (found >= 0), found)


def number(value: Column, path: str) -> Column:
    return F.when(_kind(value, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, path, "double"))


def flag(value: Column, path: str) -> Column:
    return F.when(_kind(value, path) == "BOOLEAN", F.try_variant_get(value, path, "boolean"))


def instant_ms(value: Column, path: str) -> Column:
    """Epoch milliseconds of an ISO instant with its zone, else null."""
    found = text(value, path, 64)
    return F.when(found.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.unix_millis(F.try_to_timestamp(found)))


def texts(value: Column, path: str, most: int = 128) -> Column:
    """The strings of an array that are as text() wants them; null if it isn't an array."""
    own = F.try_variant_get(value, path, "array<variant>")
    return F.filter(F.transform(own, lambda x: text(x, "$", most)), lambda x: x.isNotNull())


def has(value: Column, path: str) -> Column:
    """Whether the path is there with a value other than null."""
    found = F.try_variant_get(value, path, "variant")
    return found.isNotNull() & ~F.is_variant_null(found)


@dataclass(frozen=True)
class PageKind:
    """fields by name; needed: those without which an element is bad; own_id: what must not come twice in a page; warnings:
    (what is wrong, name), kept with a good row; rules: (what must hold, reason), beyond the needed fields; single: the
    page's data is one element, not an array."""

    fields: Mapping[str, Callable[[Column], Column]]
    needed: Sequence[str]
    own_id: Sequence[str] = ()
    warnings: Sequence[tuple[Callable[[Column], Column], str]] = ()
    rules: Sequence[tuple[Callable[[Column], Column], str]] = ()
    single: bool = False
    paged: bool = True


def _entries_bad(path: str, most: int = 128) -> Callable[[Column], Column]:
    return lambda v: F.size(texts(v, path, most)) < F.size(F.try_variant_get(v, path, "array<variant>"))


def _market(value: Column, name: str, sides: Sequence[str], point: str | None) -> Column:
    """A market's selections: (market, selection, bet_percent, money_percent, point), those with a share only."""

    def share(of: str, side: str) -> Column:
        return F.round(number(value, f"$.{name}.{of}.{side}") * 100, 2)

    rows = [
        F.struct(
            F.lit(name).alias("market"), F.lit(side).alias("selection"), share("bets_pct", side).alias("bet_percent"), share("handle_pct", side).alias("money_percent"),
            (number(value, f"$.{name}.line") if name == "total" else number(value, f"$.{name}.{side}_{point}")).alias("point"),
        )
        for side in sides
    ]
    return F.filter(F.array(*rows), lambda r: r["bet_percent"].isNotNull() | r["money_percent"].isNotNull())


SPLIT_MARKETS = {"spread": ("away", "home"), "total": ("over", "under"), "moneyline": ("away", "home")}


def _split_selections(value: Column) -> Column:
    return F.concat(*[_market(value, name, sides, "odds") for name, sides in SPLIT_MARKETS.items()])


def _shares_hold(value: Column) -> Column:
    """Each share that is given is a number from 0 to 1."""
    out = F.lit(True)
    for name, sides in SPLIT_MARKETS.items():
        for of in ("bets_pct", "handle_pct"):
            for side in sides:
                path = f"$.{name}.{of}.{side}"
                out = out & (~has(value, path) | F.coalesce(number(value, path).between(0, 1), F.lit(False)))
    return out


def _markets_hold(value: Column) -> Column:
    """A market that is given has shares of tickets or of money."""
    out = F.lit(True)
    for name in SPLIT_MARKETS:
        shares = [F.coalesce(_kind(value, f"$.{name}.{of}").startswith("OBJECT"), F.lit(False)) for of in ("bets_pct", "handle_pct")]
        out = out & (~has(value, f"$.{name}") | shares[0] | shares[1])
    return out


KINDS: dict[str, PageKind] = {
    "events": PageKind(
        fields={
            "id": lambda v: text(v, "$.id"), "sport": lambda v: text(v, "$.sport", 64), "league": lambda v: text(v, "$.league", 128), "start_ms": lambda v: instant_ms(v, "$.start_time"), "status": lambda v: text(v, "$.status", 64),
            "is_live": lambda v: flag(v, "$.is_live"), "home": lambda v: text(v, "$.home_team", 512), "away": lambda v: text(v, "$.away_team", 512), "markets": lambda v: F.coalesce(texts(v, "$.markets"), F.array().cast("array<string>")), "books": lambda v: F.coalesce(texts(v, "$.books"), F.array().cast("array<string>")),
        },
        needed=("id", "sport", "league", "start_ms", "status", "is_live"),
        own_id=("id",),
        warnings=(
            (lambda v: has(v, "$.home_team") & text(v, "$.home_team", 512).isNull(), "home-participant-invalid"), (lambda v: has(v, "$.away_team") & text(v, "$.away_team", 512).isNull(), "away-participant-invalid"),
            (lambda v: texts(v, "$.markets").isNull(), "markets-invalid"), (_entries_bad("$.markets"), "markets-entry-invalid"), (lambda v: texts(v, "$.books").isNull(), "books-invalid"), (_entries_bad("$.books"), "books-entry-invalid"),
        ),
    ),
    "leagues": PageKind(
        fields={"id": lambda v: text(v, "$.id", 128), "name": lambda v: F.coalesce(text(v, "$.display_name"), text(v, "$.name")), "sport": lambda v: text(v, "$.sport", 64), "event_count": lambda v: whole(v, "$.event_count"), "live_count": lambda v: whole(v, "$.live_count")},
        needed=("id", "name", "sport", "event_count", "live_count"),
        own_id=("sport", "id"),
        rules=((lambda v: ~F.contains(text(v, "$.id", 128), F.lit(",")), "unrepresentable-filter-id"),),
        paged=False,
    ),
    "splits": PageKind(
        fields={"event_id": lambda v: text(v, "$.event_id"), "sport": lambda v: text(v, "$.sport"), "league": lambda v: text(v, "$.league"), "book": lambda v: text(v, "$.sportsbook", 128), "home": lambda v: text(v, "$.home_team"), "away": lambda v: text(v, "$.away_team"), "at_ms": lambda v: instant_ms(v, "$.fetched_at"), "selections": _split_selections},
        needed=("event_id", "sport", "league", "book", "home", "away", "at_ms"),
        rules=((_markets_hold, "market-percentages"), (_shares_hold, "percentage")),
    ),
    "account": PageKind(
        fields={"tier": lambda v: text(v, "$.tier", 32), "features": lambda v: texts(v, "$.features", 64), "requests_per_minute": lambda v: whole(v, "$.rate_limit.requests_per_minute"), "max_books": lambda v: whole(v, "$.rate_limit.max_books"), "streaming": lambda v: flag(v, "$.streaming.enabled")},
        needed=("tier", "features", "requests_per_minute", "max_books", "streaming"),
        rules=((lambda v: ~_entries_bad("$.features", 64)(v), "features-entry"),),
        single=True,
        paged=False,
    ),
}


def elements(pages: DataFrame, page_id: str, body: str, kind: PageKind) -> DataFrame:
    """A row per element of each page: page_id, row_index from 0, value (a variant), reason of a page that isn't one.

    A page that is no JSON, has no such envelope or more than MOST_ELEMENTS elements is one row, of index -1, without value.
    """
    page = F.try_parse_json(F.col(body))
    own = pages.select(F.col(page_id).alias("page_id"), page.alias("page"))
    data = F.array(F.try_variant_get("page", "$.data", "variant")) if kind.single else F.try_variant_get("page", "$.data", "array<variant>")
    more, empty = flag(F.col("page"), "$.pagination.has_more"), F.lit(False)
    if kind.paged:  # a page without elements may say null for them
        empty = F.coalesce((more == False) & (whole(F.col("page"), "$.pagination.count") == 0) & ~has(F.col("page"), "$.data"), F.lit(False))  # noqa: E712
    wrong = first_reason(
        (F.col("page").isNull(), "page-malformed"),
        (~empty & (~has(F.col("page"), "$.data") if kind.single else F.col("data").isNull()), "page-data"),
        (F.size("data") > MOST_ELEMENTS, "page-size") if not kind.single else (F.lit(False), "page-size"),
        (more.isNull() if kind.paged else F.lit(False), "page-pagination"),
    )
    judged = own.withColumn("data", data).withColumn("reason", wrong)
    inner = F.when(F.col("reason").isNull(), F.transform(F.coalesce("data", F.array().cast("array<variant>")), lambda v, k: F.struct(k.alias("row_index"), v.alias("value"))))
    bad = F.array(F.struct(F.lit(-1).alias("row_index"), F.lit(None).cast("variant").alias("value")))
    return judged.select("page_id", "reason", F.inline(F.coalesce(inner, bad)))


def parse_pages(pages: DataFrame, page_id: str, body: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Good elements with the kind's fields and warnings, and quarantined ones with their reason, both with page_id and row_index.

    Of elements of a page with one id the first good one stays. Numbers of another kind, strings in place of flags and the
    like are bad; a field that is not needed is null then.
    """
    own = KINDS[kind]
    rows = elements(pages, page_id, body, own)
    value = F.col("value")
    read = rows.withColumns({f"f_{name}": of(value) for name, of in own.fields.items()})
    known = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    rules = [(F.col("reason").isNotNull(), "page"), (~known, "invalid-row"), *[(F.col(f"f_{n}").isNull(), "invalid-row") for n in own.needed], *[(~F.coalesce(holds(value), F.lit(False)), name) for holds, name in own.rules]]
    judged = read.withColumn("wrong", F.coalesce("reason", first_reason(*rules)))
    if own.own_id:
        w = Window.partitionBy("page_id", *[f"f_{n}" for n in own.own_id]).orderBy("row_index")
        earlier = F.count_if(F.col("wrong").isNull()).over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0
        judged = judged.withColumn("wrong", F.when(F.col("wrong").isNull() & earlier, "duplicate-provider-id").otherwise(F.col("wrong")))
    warned = issues(*[(F.coalesce(wrong(value), F.lit(False)), name) for wrong, name in own.warnings]) if own.warnings else F.array().cast("array<string>")
    good = judged.where("wrong IS NULL").select("page_id", "row_index", *[F.col(f"f_{n}").alias(n) for n in own.fields], warned.alias("warnings"))
    bad = judged.where("wrong IS NOT NULL").select("page_id", "row_index", F.col("wrong").alias("reason"), F.to_json("value").alias("element"))
    return good, bad
