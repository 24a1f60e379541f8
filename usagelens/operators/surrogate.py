"""Long item ids replaced by short ids that stay the same inside one request."""

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.functions.tokens import attach_document, member
from usagelens.runtime import materialize

# Fixed values of the short form.
ID_PREFIX = "rs_"
MAX_ID_CHARS = 64
DIGEST_CHARS = 61


def request_items(requests: DataFrame) -> DataFrame:
    """Items of each payload's ``input`` list: (request_id, pos, item_id, encrypted).

    ``item_id`` is NULL unless the item is an object with a text id.
    """
    items = F.try_variant_get("doc", "$.input", "array<variant>")
    parsed = attach_document(requests.select("request_id", "payload"), "payload", keys=("id",))
    rows = parsed.select("request_id", F.posexplode(items).alias("pos", "item"))
    item_id = member(F.col("item"), "$.id")
    return rows.select(
        "request_id", "pos",
        F.when(F.schema_of_variant(item_id) == "STRING", F.try_variant_get("item", "$.id", "string"))
        .alias("item_id"),
        member(F.col("item"), "$.encrypted_content").isNotNull().alias("encrypted"))


def short_id(item_id) -> Column:
    return F.concat(F.lit(ID_PREFIX), F.substring(F.sha2(item_id, 256), 1, DIGEST_CHARS))


def surrogate_ids(items: DataFrame) -> DataFrame:
    """Add ``new_id``: the short form of a long id that some plain item of the request has.

    A plain item with a long id decides for itself and is not shuffled.  Only an
    encrypted item with a long id has to look for a plain twin; ids that occur
    both ways come from one aggregate, each of them once.  Items are staged in
    the shared folder, so that what they are made of is read and parsed once.
    """
    items = materialize(items)
    long_id = F.length("item_id") > MAX_ID_CHARS
    plain = ~F.coalesce(F.col("encrypted"), F.lit(False))
    twins = (
        items.where(long_id).groupBy("request_id", "item_id")
        .agg(F.bool_and(plain).alias("_all"), F.bool_or(plain).alias("_twin"))
        .where("_twin AND NOT _all").drop("_all")
    )
    settled = items.where(F.coalesce(~long_id | plain, F.lit(True))).withColumn(
        "new_id", F.when(long_id, short_id(F.col("item_id"))).otherwise(F.col("item_id")))
    open_items = items.where(long_id & ~plain).join(twins, ["request_id", "item_id"], "left")
    looked_up = open_items.withColumn(
        "new_id", F.when(F.col("_twin"), short_id(F.col("item_id"))).otherwise(F.col("item_id")))
    return settled.unionByName(looked_up.drop("_twin"))
