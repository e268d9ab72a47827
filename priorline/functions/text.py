"""Name and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_name(name: Column) -> Column:
    """Drop a "(#12)" tag, turn dots into spaces, collapse spaces."""
    plain = F.regexp_replace(name, r"\(#\d+\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\.", " "), r"\s+", " "))


def first_last(name: Column) -> Column:
    """"Last, First" -> "First Last"; other text unchanged."""
    parts = F.split(name, r",\s*")
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(F.get(parts, F.lit(1))), F.trim(F.get(parts, F.lit(0))))).otherwise(name)


def matchup_sides(matchup: Column) -> tuple[Column, Column]:
    """(away, home) of "A @ B"; null when there is no such split."""
    parts = F.split(matchup, r"\s*@\s*")
    ok = F.size(parts) == 2
    return F.when(ok, F.trim(parts[0])), F.when(ok, F.trim(F.get(parts, F.lit(1))))


def slug(text: Column) -> Column:
    """Lower-case words joined by underscores; empty becomes null."""
    raw = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_")
    return F.nullif(F.regexp_replace(raw, "^_+|_+$", ""), F.lit(""))


def normal_pick(text: Column) -> Column:
    """OVER, UNDER or PUSH from the usual spellings; anything else is null."""
    t = F.upper(F.trim(text))
    return (
        F.when(t.isin("OVER", "O", "1", "TRUE", "YES"), "OVER")
        .when(t.isin("UNDER", "U", "0", "FALSE", "NO"), "UNDER")
        .when(t == "PUSH", "PUSH")
    )


def minutes(text: Column) -> Column:
    """"MM:SS", a number or blank -> minutes; unreadable text counts 0."""
    t = F.trim(text)
    whole = F.regexp_extract(t, r"^([^:]*):\s*(\d+)\s*$", 1).try_cast("double")
    seconds = F.regexp_extract(t, r"^([^:]*):\s*(\d+)\s*$", 2).try_cast("int")
    clock = whole + seconds / 60.0
    return F.coalesce(F.when(t.contains(":"), clock).otherwise(t.try_cast("double")), F.lit(0.0))


def contribution_pairs(text: Column) -> Column:
    """"f:+0.3,g:-0.1" -> array of (feature, value); malformed parts are skipped, names may hold colons."""
    parts = F.split(text, ",")

    def pair(p: Column) -> Column:
        name = F.trim(F.regexp_extract(p, r"^(.*):([^:]*)$", 1))
        value = F.trim(F.regexp_extract(p, r"^(.*):([^:]*)$", 2)).try_cast("double")
        return F.struct(name.alias("feature"), value.alias("value"))

    return F.filter(F.transform(parts, pair), lambda s: s["value"].isNotNull() & (s["feature"] != ""))


def run_label(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def first_known(*values: Column, default: str = "unknown") -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values], F.lit(default))


# Patterns of the report columns, tried in this order.
REPORT_PATTERNS = {
    "game_date": r"^\d{2}/\d{2}/\d{4}$",
    "game_time": r"^\d{2}:\d{2} \(ET\)$",
    "matchup": r"^[A-Z]{3}@[A-Z]{3}$",
    "team": r"^[A-Z][a-zA-Z]*(?:\s[A-Z][a-zA-Z]*)+$",
    "player": r"^[A-Z][a-zA-Z'.\- ]+, [A-Z][a-zA-Z'.\-]+",
    "status": r"^[A-Z][a-zA-Z]*$",
}
SPECIAL_TEAM = "Philadelphia 76ers"  # fixed value: the team whose name holds digits, so the team pattern misses it
REPORT_STATUSES = ("Out", "Questionable", "Probable", "Doubtful", "Available")  # fixed values
NOT_SUBMITTED = "NOT YET SUBMITTED"  # fixed value


def token_kind(token: Column, after_player: Column) -> Column:
    """Report column a token belongs to; after a player name only a status or the reason can follow."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(REPORT_PATTERNS.items()):
        match = token.rlike(pattern)
        if kind == "team":
            match = match | (token == SPECIAL_TEAM)
        allowed = match if kind == "status" else match & ~after_player
        out = F.when(allowed, kind).otherwise(out)
    return F.when(token == NOT_SUBMITTED, "reason").otherwise(out)
