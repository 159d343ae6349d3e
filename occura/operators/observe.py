"""Observation documents into archive tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occura import schema
from occura.functions import scalars as S
from occura.operators.lookups import TIMES, fetch


def taxon_ids(obs: DataFrame) -> DataFrame:
    """Distinct ids in the lineages of observations and their identifications."""
    own = F.coalesce(F.col("taxon.ancestor_ids"), F.array().cast("array<int>"))
    theirs = F.flatten(F.transform(F.coalesce("identifications", F.array().cast(obs.schema["identifications"].dataType)), lambda i: F.coalesce(i["taxon"]["ancestor_ids"], F.array().cast("array<int>"))))
    return obs.select(F.explode(F.concat(own, theirs)).alias("taxon_id")).filter("taxon_id is not null").distinct()


def lineage(df: DataFrame, taxa: DataFrame, ids: str = "lineage_ids", key: str = "key") -> DataFrame:
    """(key, rank columns, infraspecies, higher_classification): names of the lineage's taxa; of one rank the later counts; unknown ids are left out."""
    found = with_lineage(df.select(key, F.col(ids).alias("_ids")), taxa, key)
    return found.filter("_known").drop("_ids", "_known")


def with_lineage(rows: DataFrame, taxa: DataFrame, by: str) -> DataFrame:
    """``rows`` with the columns of ``lineages`` for the list in ``_ids``, and ``_known``: whether a taxon of it is known.

    Lineages are computed once for each distinct list; a popular taxon's list is looked up without gathering its rows.
    """
    return fetch(rows, lineages(rows, taxa).withColumn("_known", F.lit(True)), "_ids", by).withColumn("_known", F.coalesce("_known", F.lit(False)))


def lineages(rows: DataFrame, taxa: DataFrame, ids: str = "_ids") -> DataFrame:
    """The columns of ``lineage`` for each distinct list of taxon ids, and how many rows have it; lists without a known taxon are left out."""
    names = taxa.select(F.col("id").alias("taxon_id"), "name", "rank", "rank_level")
    lists = rows.filter(F.size(ids) > 0).groupBy(ids).agg(F.count("*").alias(TIMES))
    placed = lists.select(ids, TIMES, F.posexplode(ids).alias("at", "taxon_id")).join(names, "taxon_id")
    last = lambda test: F.max(F.when(test & F.col("name").isNotNull(), F.struct("at", "name")))["name"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " | ")
    return placed.groupBy(ids).agg(F.max(TIMES).alias(TIMES), *[last(F.col("rank") == r).alias(r) for r in schema.RANKS], last(F.col("rank") == "section").alias("section"), last(F.col("rank_level") == 5.0).alias("infraspecies"), F.nullif(text, F.lit("")).alias("higher_classification"))


def media_identifier(mapped: Column, url: Column) -> Column:
    """Local path if the medium was downloaded, else its address."""
    return F.coalesce(mapped, url)


def _mapped(df: DataFrame, mapping: DataFrame | None, key: Column) -> DataFrame:
    """``df`` with ``local``: the path that the mapping (id, path) has for the key."""
    if mapping is None:
        return df.withColumn("local", F.lit(None).cast("string"))
    return df.withColumn("_key", key).join(mapping.select(F.col("id").alias("_key"), F.col("path").alias("local")), "_key", "left").drop("_key")


def _columns(fields: list[str], **values: Column) -> list[Column]:
    """All fields in order, those without a value null."""
    return [values.get(f, F.lit(None).cast("string")).alias(f) for f in fields]


def _occurrence_id() -> Column:
    return F.coalesce(S.uri("observation", F.col("id")), F.lit(""))


def to_occurrences(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    """One occurrence row per observation: the written fields, then those that are computed but not written."""
    ids = F.coalesce(F.col("taxon.ancestor_ids"), F.array().cast("array<int>"))
    rows = obs.withColumn("_ids", ids)
    rows = with_lineage(rows, taxa, "id")
    lat, lng = S.point(F.col("geojson"), F.col("private_geojson"))
    year, month, day = S.date_parts(F.col("observed_on"))
    written = _columns(
        schema.OCCURRENCE_FIELDS, occurrenceID=_occurrence_id(), basisOfRecord=F.lit("HumanObservation"), recordedBy=F.coalesce("user.login", F.lit("")), eventDate=F.col("observed_on"),
        decimalLatitude=lat, decimalLongitude=lng, scientificName=F.col("taxon.name"), taxonRank=F.col("taxon.rank"), taxonomicStatus=F.lit("accepted"), vernacularName=F.col("taxon.preferred_common_name"),
        **{r: F.col(r) for r in ("kingdom", "phylum", "class", "order", "family", "genus")}, taxonID=S.uri("taxon", F.col("taxon.id")), occurrenceRemarks=F.col("description"), establishmentMeans=S.establishment(F.col("captive")),
        coordinateUncertaintyInMeters=S.uncertainty(F.col("private_geojson"), F.col("positional_accuracy"), F.col("public_positional_accuracy")), geodeticDatum=F.lit("WGS84"), license=F.col("license_code"),
        informationWithheld=S.information_withheld(F.col("geoprivacy"), F.col("taxon_geoprivacy"), F.col("private_geojson").isNotNull()), modified=F.col("updated_at"), captive=F.col("captive"),
        eventTime=S.time_part(F.col("time_observed_at")), verbatimEventDate=F.col("observed_on_string"), verbatimLocality=F.coalesce("private_place_guess", "place_guess"),
    )
    computed = [
        (lat.isNotNull() & lng.isNotNull()).alias("hasCoordinate"), F.col("place_guess").alias("locationRemarks"), year.alias("year"), month.alias("month"), day.alias("day"), F.lit("Observation").alias("eventType"),
        F.col("description").alias("eventRemarks"), *[F.col(r) for r in ("subfamily", "subgenus", "tribe", "subtribe", "superfamily", "species")], F.lit("iNaturalist").alias("institutionCode"), F.lit("Observations").alias("collectionCode"),
        F.col("id").cast("string").alias("catalogNumber"), S.annotation(F.col("annotations"), "Life Stage", schema.LIFE_STAGES).alias("lifeStage"), S.sex(F.col("annotations")).alias("sex"),
        S.annotation(F.col("annotations"), "Flowers and Fruits").alias("reproductiveCondition"),
    ]
    return rows.select(*written, *computed)


def to_photo_multimedia(obs: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    rows = _mapped(obs.select("id", "user", F.explode("photos").alias("m")), mapping, F.col("m.id"))
    url = F.when(F.col("m.id").isNotNull(), media_identifier(F.col("local"), S.original_url(F.col("m.url"))))
    return rows.select(*_columns(schema.MULTIMEDIA_FIELDS, occurrenceID=_occurrence_id(), type=F.lit("StillImage"), format=F.lit("image/jpeg"), identifier=url, references=S.photo_reference(F.col("m.id")), creator=F.col("user.login"), publisher=F.lit("iNaturalist"), license=F.col("m.license_code"), rightsHolder=F.col("user.login")))


def to_sound_multimedia(obs: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Sounds that are not hidden and have an address or a local file."""
    rows = _mapped(obs.select("id", "user", F.explode(S.visible(F.col("sounds"))).alias("m")), mapping, F.col("m.id")).filter(F.col("m.file_url").isNotNull() | F.col("local").isNotNull())
    return rows.select(*_columns(schema.MULTIMEDIA_FIELDS, occurrenceID=_occurrence_id(), type=F.lit("Sound"), format=F.col("m.file_content_type"), identifier=media_identifier(F.col("local"), F.col("m.file_url")), references=S.uri("sound", F.col("m.id")), creator=F.col("user.login"), publisher=F.lit("iNaturalist"), license=F.col("m.license_code"), rightsHolder=F.col("user.login")))


def to_multimedia(obs: DataFrame, photos: DataFrame | None = None, sounds: DataFrame | None = None) -> DataFrame:
    return to_photo_multimedia(obs, photos).union(to_sound_multimedia(obs, sounds))


def to_audiovisual(obs: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    rows = _mapped(obs.select("id", "user", "taxon", "geojson", F.explode("photos").alias("m")), mapping, F.col("m.id"))
    numbers = F.col("geojson.coordinates")
    at = lambda k: F.when(F.size(numbers) >= 2, F.try_element_at(numbers, F.lit(k)))
    page = F.concat(F.lit(f"{S.SITE}/photos/"), F.col("m.id").cast("string"))
    url = F.when(F.col("m.id").isNotNull(), media_identifier(F.col("local"), S.original_url(F.col("m.url"))))
    return rows.select(
        *_columns(
            schema.AUDIOVISUAL_FIELDS, occurrenceID=_occurrence_id(), identifier=page, type=F.lit("StillImage"), metadataLanguageLiteral=F.lit("en"), available=F.lit("online"), rights=F.col("m.license_code"), owner=F.col("user.login"),
            usageTerms=F.col("m.license_code"), credit=F.col("m.attribution"), attributionLinkURL=page, source=F.lit("iNaturalist"), scientificName=F.col("taxon.name"), commonName=F.col("taxon.preferred_common_name"),
            decimalLatitude=at(2), decimalLongitude=at(1), accessURI=url, format=F.lit("image/jpeg"), pixelXDimension=F.lit(None).cast("int"), pixelYDimension=F.lit(None).cast("int"),
        )
    )


def to_identifications(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    rows = obs.select("id", F.explode("identifications").alias("i"))
    ids = F.when(F.col("i.taxon").isNotNull(), F.concat(F.array("i.taxon.id"), F.coalesce(F.col("i.taxon.ancestor_ids"), F.array().cast("array<int>"))))
    rows = rows.withColumn("_ids", ids)
    rows = with_lineage(rows.withColumn("_ident", F.col("i.id")), taxa, "_ident")
    user = F.col("i.user")
    who = F.when(user.isNotNull(), S.join_nonempty(user["login"], user["name"]))
    whose = F.when(user.isNotNull(), S.join_nonempty(user["orcid"], S.uri("user", user["id"])))
    taxon = F.col("i.taxon")
    return rows.select(
        *_columns(
            schema.IDENTIFICATION_FIELDS, occurrenceID=_occurrence_id(), identificationID=F.col("i.id").cast("string"), identifiedBy=who, identifiedByID=whose, dateIdentified=F.col("i.created_at"), identificationRemarks=F.col("i.body"),
            taxonID=S.uri("taxon", taxon["id"]), scientificName=taxon["name"], taxonRank=taxon["rank"], vernacularName=taxon["preferred_common_name"], taxonomicStatus=S.taxon_status(taxon.isNotNull(), taxon["is_active"]),
            higherClassification=F.col("higher_classification"), **{r: F.col(r) for r in schema.RANKS if r != "species"}, infragenericEpithet=F.col("section"), specificEpithet=S.epithet(F.col("species"), 2),
            infraspecificEpithet=S.epithet(F.col("infraspecies"), 3), identificationVerificationStatus=S.identification_status(F.col("i.category")), identificationCurrent=F.col("i.current"),
        )
    )


def to_comments(obs: DataFrame) -> DataFrame:
    rows = obs.select("id", F.explode(S.visible(F.col("comments"))).alias("c"))
    user = F.col("c.user")
    return rows.select(*_columns(schema.COMMENT_FIELDS, occurrenceID=_occurrence_id(), identifier=F.nullif(S.join_nonempty(S.uri("comment", F.col("c.id")), F.col("c.uuid")), F.lit("")), text=F.col("c.body"), author=F.nullif(S.join_nonempty(user["login"], user["name"]), F.lit("")), authorID=S.uri("user", user["id"]), created=F.col("c.created_at")))


def observations_flat(obs: DataFrame) -> DataFrame:
    """Flat 18-column table of observations."""
    at = lambda p, k: F.when(F.size(F.col(f"{p}.coordinates")) >= 2, F.try_element_at(F.col(f"{p}.coordinates"), F.lit(k)))
    return obs.select(
        "id", F.col("user.login").alias("user_login"), F.col("taxon.name").alias("taxon_name"), F.col("taxon.id").alias("taxon_id"), at("geojson", 2).alias("latitude"), at("geojson", 1).alias("longitude"),
        at("private_geojson", 2).alias("private_latitude"), at("private_geojson", 1).alias("private_longitude"), "positional_accuracy", "public_positional_accuracy", "obscured", "geoprivacy", "taxon_geoprivacy", "updated_at", "captive",
        "time_observed_at", "observed_on_string", "place_guess",
    )
