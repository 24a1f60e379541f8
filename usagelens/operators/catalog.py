"""Model ids out of model-catalog snapshots."""

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.tokens import attach_document, member
from usagelens.operators import claims

cloudpickle.register_pickle_by_value(claims)

# Keys that may hold an id, in order, and the accepted form.
ID_KEYS = ("id", "slug", "model", "model_id", "model_slug")
ID_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._-]{1,79}\z"

_NO_IDS = "array<string>"


def _valid_id(value: Column, path: str) -> Column:
    """Text at ``path`` if it is an accepted id; its kind is only looked up when the form fits."""
    text = F.try_variant_get(value, path, "string")
    return F.when(text.rlike(ID_PATTERN), F.when(F.to_json(member(value, path)).startswith('"'), text))


def _attach_ids(snapshots: DataFrame) -> DataFrame:
    """Add ``ids``: the accepted ids of each payload, in order, each once; NULL without a list.

    An item gives its first valid id that no earlier item gave. Where all items' first ids differ, those are the answer
    and stay in the JVM; the other catalogs are settled item by item, in time linear in their length.
    """
    doc = F.col("doc")
    models = F.coalesce(F.try_variant_get(doc, "$.models", "array<variant>"),
                        F.try_variant_get(doc, "$.data", "array<variant>"))
    names = F.transform(models, lambda item: F.array_compact(F.array(
        _valid_id(item, "$"), *[_valid_id(item, f"$.{key}") for key in ID_KEYS])))
    parsed = attach_document(snapshots.select("snapshot_id", "payload"), "payload", keys=ID_KEYS)
    listed = parsed.select("snapshot_id", F.filter(names, lambda of_item: F.size(of_item) > 0).alias("names"))
    first = F.transform("names", lambda of_item: of_item[0])
    split = listed.select("snapshot_id", "names", first.alias("first")).select(
        "snapshot_id", "first", F.when(F.size(F.array_distinct("first")) < F.size("first"), F.col("names")).alias("contested"))
    settled = F.pandas_udf(claims.first_claims, _NO_IDS)("contested")
    return split.select("snapshot_id", F.coalesce(settled, F.col("first")).alias("ids"))


def model_catalog(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, position, model_id) of every snapshot."""
    return _listed(_attach_ids(snapshots))


def _listed(snapshots: DataFrame) -> DataFrame:
    """One row per id. An inner generator would make the optimizer test the size of ``ids`` below the projection, and
    so fold and parse every payload once more."""
    rows = snapshots.select("snapshot_id", F.posexplode_outer("ids").alias("position", "model_id"))
    return rows.where(F.col("position").isNotNull())


def model_catalog_merged(snapshots: DataFrame, configured) -> DataFrame:
    """Catalog followed by the configured models, first occurrence wins.

    A snapshot without any usable id shows the configured list alone.
    """
    own = F.coalesce("ids", F.array().cast(_NO_IDS))
    fixed = F.array(*[F.lit(name) for name in configured]).cast(_NO_IDS)
    merged = _attach_ids(snapshots).select("snapshot_id", F.array_distinct(F.concat(own, fixed)).alias("ids"))
    return _listed(merged)
