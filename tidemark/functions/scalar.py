"""Small column helpers: bands, labels, item names, clock strings, points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(x: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """The label of the band between two edges: (a, b] or, not ``right``, [a, b); null outside."""
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        inside = (x > a) & (x <= b) if right else (x >= a) & (x < b)
        out = F.when(inside, label).otherwise(out)
    return out


def band_number(x: Column, edges: Sequence[float], right: bool = True) -> Column:
    """The same as an ordinal from 0."""
    return bands(x, edges, [str(k) for k in range(len(edges) - 1)], right).cast("int")


def equal_bins(place: Column, n: Column, bins: int) -> Column:
    """1 to ``bins`` from a row number: the bin edges are the quantiles of the numbers themselves."""
    return F.greatest(F.ceil((place - 1) * bins / F.nullif(n - 1, F.lit(0))), F.lit(1)).cast("int")


def even_second(t: Column) -> Column:
    return F.rint(t)


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("long"), (whole % 60).cast("long"))


def clock_seconds(text: Column) -> Column:
    """``mm:ss`` as seconds; anything else is null."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 2, parts[0].try_cast("double") * 60 + parts[1].try_cast("double"))


def lenient_date(text: Column) -> Column:
    return text.try_cast("date")


def week(date: Column) -> Column:
    """The Monday that begins the date's week."""
    return F.date_trunc("week", date).cast("date")


def season(branch: Column) -> Column:
    """``vN.N`` of a release branch, else the branch as it is."""
    version = F.regexp_extract(branch, r"Release-(\d+\.\d+)", 1)
    return F.when(version != "", F.concat(F.lit("v"), version)).otherwise(branch)


#: Rarity words in ascending order (fixed values).
RARITIES = ("common", "uncommon", "rare", "epic", "legendary", "mythic")
#: Marks in an item's name and the rarity they stand for; the first that occurs counts (fixed values).
RARITY_MARKS = (("_mythic", "mythic"), ("_sr_", "legendary"), ("_vr_", "epic"), ("_r_", "rare"), ("_uc_", "uncommon"), ("_c_", "common"))
#: Words in an item's name and its category; the first that occurs counts, after ^ at the beginning only (fixed values).
CATEGORIES = (
    ("ammo", "ammo"),
    ("wooditemdata", "materials"), ("stoneitemdata", "materials"), ("metalitemdata", "materials"),
    ("shield", "heal/shield"), ("bandage", "heal/shield"), ("medkit", "heal/shield"), ("medbox", "heal/shield"),
    ("chug", "heal/shield"), ("flopper", "heal/shield"), ("slurp", "heal/shield"), ("apple", "heal/shield"),
    ("pepper", "heal/shield"), ("mushroom", "heal/shield"), ("consumable", "heal/shield"), ("heal", "heal/shield"),
    ("pickaxe", "pickaxe"), ("harvest", "pickaxe"),
    ("buildingitemdata", "build tool"), ("edittool", "build tool"), ("buildingtool", "build tool"),
    ("^wid_", "weapon"), ("shotgun", "weapon"), ("assault", "weapon"), ("smg", "weapon"), ("pistol", "weapon"),
    ("sniper", "weapon"), ("rifle", "weapon"), ("launcher", "weapon"),
)
#: Words in a weapon's name and its class; the first that occurs counts (fixed values).
WEAPON_CLASSES = (
    ("shotgun", "shotgun"), ("assault", "assault rifle"), ("_ar_", "assault rifle"), ("corear", "assault rifle"),
    ("smg", "SMG"), ("drumgun", "SMG"), ("pdw", "SMG"), ("pistol", "pistol"), ("sniper", "sniper"), ("dmr", "sniper"),
    ("launcher", "explosive"), ("rocket", "explosive"), ("grenade", "explosive"),
)
#: Parts of a weapon's id that are not part of its name (fixed values).
WEAPON_ID_PARTS = ("WID", "Athena", "Ore", "ORE", "C", "UC", "R", "VR", "SR", "UR")


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, the value worked out once however often it is named there: a variable of a function on a list of one."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def first_word(text: Column, table: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    def first(low: Column) -> Column:
        out = F.lit(otherwise).cast("string")
        for word, label in reversed(table):
            out = F.when(low.startswith(word[1:]) if word.startswith("^") else low.contains(word), label).otherwise(out)
        return out

    return once(F.lower(text), first)


def item_name(path: Column) -> Column:
    """The last part of an item's path; null for an empty one."""
    return F.when(F.length(path) > 0, F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), -1))


def item_category(path: Column) -> Column:
    return once(item_name(path), lambda name: F.when(name.isNotNull(), first_word(name, CATEGORIES, "other")))


def item_rarity(path: Column) -> Column:
    """From a mark in the name, else from its tier; null without either."""
    of_tier = lambda tier: F.when(tier.between(1, 5), F.get(F.array(*map(F.lit, RARITIES)), tier - 1))
    by_tier = lambda name: once(F.regexp_extract(F.lower(name), r"_t0?(\d)\b", 1).try_cast("int"), of_tier)
    return once(item_name(path), lambda name: F.coalesce(first_word(F.concat(name, F.lit("_")), RARITY_MARKS), by_tier(name)))


def rarity_rank(rarity: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, word in enumerate(RARITIES):
        out = F.when(F.lower(rarity) == word, k + 1).otherwise(out)
    return out


def weapon_class(name: Column) -> Column:
    return F.when(name.isNotNull(), first_word(name, WEAPON_CLASSES, "other weapon"))


def readable_weapon(name: Column) -> Column:
    """The first three words of a weapon's id that name it; the id itself if none does."""
    words = F.filter(F.split(name, "_"), lambda w: (F.length(w) > 0) & ~w.isin(*WEAPON_ID_PARTS) & ~w.startswith("T0"))
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 3), " "), F.lit("")), name)


def build_material(kind: Column) -> Column:
    letter = F.regexp_extract(kind, r"PBWA_([WSM])\d", 1)
    return F.when(letter == "W", "wood").when(letter == "S", "stone").when(letter == "M", "metal")


def target_kind(is_player: Column, is_build: Column) -> Column:
    return F.when(F.coalesce(is_player, F.lit(False)), "player").when(F.coalesce(is_build, F.lit(False)), "build").otherwise("object")


def strength(p: Column, alpha: float = 0.01) -> Column:
    """Words for a p-value; a missing one shows nothing."""
    return F.when(p < alpha / 10, "strong").when(p < alpha, "clear").when(p < 0.05, "weak").otherwise("none")


def verdict(p: Column, effect: Column, alpha: float = 0.05, least: float = 0.3) -> Column:
    return (
        F.when(p.isNull(), "Too few")
        .when((p < alpha) & (F.abs(effect) >= least), "Divergent")
        .when(p < alpha, "Slight")
        .otherwise("Similar")
    )
