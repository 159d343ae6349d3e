"""Scalar pieces of observation records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from occura import schema

SITE = "https://www.inaturalist.org"


def uri(kind: str, key: Column) -> Column:
    """URI of an observation, taxon, sound, user or comment; photos have http and www; null for null."""
    # Paths by kind.
    paths = {"observation": "observations", "taxon": "taxa", "sound": "sounds", "user": "users", "comment": "comments", "photo": "photos"}
    return F.concat(F.lit(f"{SITE}/{paths[kind]}/"), key.cast("string"))


def photo_reference(key: Column) -> Column:
    return F.concat(F.lit("http://www.inaturalist.org/photos/"), F.coalesce(key, F.lit(0)).cast("string"))


def original_url(url: Column) -> Column:
    """Every size word in a photo's address becomes ``original``."""
    for size in ("square", "small", "medium", "large"):
        url = F.replace(url, F.lit(size), F.lit("original"))
    return url


def join_nonempty(*parts: Column, sep: str = "|") -> Column:
    """Non-null, non-empty parts with a separator between; '' when there is none."""
    return F.array_join(F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x != ""), sep)


def point(public: Column, private: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of the private point if there is one, else of the public; null with fewer than two numbers."""
    numbers = F.when(private.isNotNull(), private["coordinates"]).otherwise(public["coordinates"])
    enough = F.size(numbers) >= 2
    return F.when(enough, F.try_element_at(numbers, F.lit(2))), F.when(enough, F.try_element_at(numbers, F.lit(1)))


def uncertainty(private: Column, accuracy: Column, public_accuracy: Column) -> Column:
    return F.when(private.isNotNull(), accuracy).otherwise(public_accuracy).cast("double")


# Sentences on withheld coordinates, by whose setting counts, its value, and whether the private point is included.
WITHHELD = {
    ("observer", "private", False): "Coordinates hidden by the observer",
    ("observer", "private", True): "Coordinates hidden by the observer but included here with the observer's permission",
    ("observer", "obscured", False): "Coordinates obscured by the observer",
    ("observer", "obscured", True): "Coordinates obscured by the observer but included here with the observer's permission",
    ("taxon", "private", False): "Coordinates hidden due to iNaturalist taxon geoprivacy",
    ("taxon", "private", True): "Coordinates hidden due to iNaturalist taxon geoprivacy but included here with the observer's permission",
    ("taxon", "obscured", False): "Coordinates obscured due to iNaturalist taxon geoprivacy",
    ("taxon", "obscured", True): "Coordinates obscured due to iNaturalist taxon geoprivacy but included here with the observer's permission",
}


def information_withheld(geoprivacy: Column, taxon_geoprivacy: Column, has_private_point: Column) -> Column:
    """Sentence on why coordinates are withheld; only without an own setting does the taxon's count."""

    def sentence(setting: Column, whose: str) -> Column:
        said = lambda value: F.when(has_private_point, WITHHELD[whose, value, True]).otherwise(WITHHELD[whose, value, False])
        return F.when(setting == "private", said("private")).when(setting == "obscured", said("obscured"))

    return F.when(geoprivacy.isNotNull(), sentence(geoprivacy, "observer")).otherwise(sentence(taxon_geoprivacy, "taxon"))


def establishment(captive: Column) -> Column:
    return F.when(F.coalesce(captive, F.lit(False)), "managed").otherwise("native")


def date_parts(date: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of exactly three parts between dashes, each null where it is no integer."""
    parts = F.split(date, "-")
    part = lambda k: F.when((F.size(parts) == 3) & parts[k].rlike(r"^[+-]?[0-9]+$"), parts[k].try_cast("int"))
    return part(0), part(1), part(2)


def time_part(moment: Column) -> Column:
    """Text between the first and second T without trailing Zs; null without a T."""
    return F.regexp_replace(F.try_element_at(F.split(moment, "T"), F.lit(2)), "Z+$", "")


def epithet(name: Column, word: int) -> Column:
    return F.try_element_at(F.split(F.trim(name), r"\s+"), F.lit(word))


def identification_status(category: Column) -> Column:
    return F.when(category.isin("leading", "supporting", "maverick", "improving"), F.concat(F.lit(f"{SITE}/terminology/"), category))


def taxon_status(has_taxon: Column, is_active: Column) -> Column:
    return F.when(has_taxon, F.when(F.coalesce(is_active, F.lit(True)), "active").otherwise("inactive"))


def sound_extension(content_type: Column) -> Column:
    out = None
    for extension, types in schema.SOUND_TYPES.items():
        out = F.when(content_type.isin(*types), extension) if out is None else out.when(content_type.isin(*types), extension)
    return out.otherwise("bin")


def media_path(date: Column, key: Column, extension: Column) -> Column:
    """media/year/month/day/key.extension from a date's first three parts; media/unknown/ otherwise."""
    parts = F.split(date, "-")
    name = F.concat(key.cast("string"), F.lit("."), extension)
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.lit("media"), F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)), name)).otherwise(F.concat(F.lit("media/unknown/"), name))


def is_sound(kind: Column, form: Column) -> Column:
    return F.coalesce(kind == "Sound", F.lit(False)) | F.coalesce(form.startswith("audio/"), F.lit(False))


def annotation(annotations: Column, attribute: str, vocabulary: list[str] | tuple[str, ...] | None = None) -> Column:
    """Value of the attribute's annotation with the highest vote of 0 or more, the last on ties; null if the vocabulary lacks it."""
    prefix = f"{attribute}="
    numbered = F.transform(annotations, lambda a, k: F.struct(F.coalesce(a["vote_score"], F.lit(0)).alias("vote"), k.alias("at"), a["concatenated_attr_val"].alias("value")))
    best = F.array_max(F.filter(numbered, lambda a: a["value"].startswith(prefix) & (a["vote"] >= 0)))
    value = F.lower(F.substr(best["value"], F.lit(len(prefix) + 1)))
    return F.when(value.isin(*vocabulary), value) if vocabulary else value


def sex(annotations: Column) -> Column:
    value = annotation(annotations, "Sex", schema.SEXES)
    return F.when(value == "cannot be determined", "undetermined").otherwise(value)


def visible(items: Column) -> Column:
    """Comments or sounds that are not hidden; a null flag hides nothing."""
    return F.filter(items, lambda x: ~F.coalesce(x["hidden"], F.lit(False)))
