"""The user dimension as a fold over a change log, without a loop per change.

A change log has (seq, op, api_key, username, fields).  ``op`` is add, enable,
disable, update or delete; ``fields`` maps the written columns to text values,
and a present NULL clears.  A change with an api_key concerns that key, one
without concerns every key that has the username at that point.
"""

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from usagelens.operators import keylife
from usagelens.operators.auth import auto_username
from usagelens.operators.ordered import last_before, running_before
from usagelens.runtime import materialize
from usagelens.schema import USERS
from usagelens.sources.ledger import conform

cloudpickle.register_pickle_by_value(keylife)

# Columns a partial update may write, with their types.
UPDATABLE = {"daily_token_limit": "long", "daily_request_limit": "long", "rpm_limit": "long",
             "expires_at": "long", "note": "string"}
BEFORE_LOG = -1
LOG_SLICE = 100_000

# Notes of seeded and auto-registered accounts.
NOTE_AUTO, NOTE_LEGACY, NAME_LEGACY = "auto (transition)", "transition key", "legacy"


def cli_limit_fields(**flags: Column) -> Column:
    """Fields of a limit command: only given flags are written, 0 means unlimited."""
    entries = [F.when(value.isNotNull(), F.struct(F.lit(name), F.nullif(value, F.lit(0)).cast("string")))
               for name, value in flags.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def form_limit_fields(**boxes: Column) -> Column:
    """Fields of a limit form: every box is written, anything but digits clears."""
    entries = []
    for name, value in boxes.items():
        text = F.trim(value)
        entries.append(F.struct(F.lit(name), F.when(text.rlike(r"\A[0-9]+\z"), text)))
    return F.map_from_entries(F.array(*entries))


def _has_key():
    return F.coalesce("api_key", F.lit("")) != ""


def _adds(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Every way a key comes into being: (api_key, username, seq, first values)."""
    field = F.col("fields")
    logged = changes.where(F.col("op") == "add").select(
        "api_key", "username", "seq", F.lit(1).alias("enabled"),
        F.coalesce(F.try_element_at(field, F.lit("created_at")).cast("long"), F.lit(0).cast("long")).alias("created_at"),
        *[F.try_element_at(field, F.lit(name)).cast(kind).alias(name) for name, kind in UPDATABLE.items()])
    initial = users.select("api_key", "username", F.lit(BEFORE_LOG).cast("long").alias("seq"),
                           "enabled", "created_at", *UPDATABLE)
    return initial.unionByName(logged)


def _effective_adds(adds: DataFrame, changes: DataFrame) -> DataFrame:
    """The add that made each key that is alive at the end of the log.

    Only adds after the last deletion of the key itself matter.  If they all have
    one username, the survivor is the first add after the last deletion of that
    name.  Keys that were added under several names need the order of events.
    """
    deletes = changes.where(F.col("op") == "delete")
    by_key = deletes.where(_has_key()).groupBy("api_key").agg(F.max("seq").alias("_key_end"))
    by_name = deletes.where(~_has_key()).groupBy("username").agg(F.max("seq").alias("_name_end"))
    before = F.lit(BEFORE_LOG - 1).cast("long")
    fresh = adds.join(by_key, "api_key", "left").where(
        F.col("seq") > F.coalesce("_key_end", before)).drop("_key_end")
    names = fresh.groupBy("api_key").agg(
        (F.min("username") != F.max("username")).alias("_several"))
    # Read three times below, and no larger than the user table and the adds of the log.
    fresh = materialize(fresh.join(names, "api_key"))
    alive = (
        fresh.where(~F.col("_several")).join(by_name, "username", "left")
        .where(F.col("seq") > F.coalesce("_name_end", before))
        .groupBy("api_key").agg(F.min("seq").alias("seq"))
    )
    several = fresh.where("_several")
    if not several.isEmpty():
        lives = key_lives(several, deletes).where("ends IS NULL")
        alive = alive.unionByName(lives.select("api_key", "seq"))
    return fresh.drop("_several").join(alive, ["api_key", "seq"])


def _next_delete(adds: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """(api_key, seq, ends): the first deletion after each add that names the same ``key``."""
    marked = adds.select("api_key", "username", "seq").withColumn("_delete", F.lit(None).cast("long"))
    other = ({"api_key", "username"} - {key}).pop()
    events = marked.unionByName(deletes.select(
        key, F.lit(None).cast("string").alias(other), "seq", F.col("seq").alias("_delete")))
    # The next deletion is the nearest one before in descending order.
    reverse = events.withColumn("_back", -F.col("seq"))
    found = last_before(reverse, [key], "_back", "_delete", "ends", LOG_SLICE)
    return found.where(F.col("_delete").isNull()).select("api_key", "username", "seq", "ends")


def key_lives(adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """(api_key, username, seq, ends): every add that had an effect and the deletion that ended it.

    While a key lives under one name, its adds share the deletion that ends it, so the first of them is the one with
    an effect. Only keys that were added under several names take the ordered pass, which holds nothing but the end of
    the current life.
    """
    by_name = _next_delete(adds, deletes.where(~_has_key()), "username")
    by_key = _next_delete(adds, deletes.where(_has_key()), "api_key").withColumnRenamed("ends", "_key_ends")
    ended = by_name.join(by_key.drop("username"), ["api_key", "seq"]).withColumn(
        "ends", F.least("ends", "_key_ends")).select("api_key", "username", "seq", "ends")
    ended = materialize(ended)
    several = ended.groupBy("api_key").agg(F.min("username").alias("_a"), F.max("username").alias("_b")).where(
        "NOT (_a <=> _b)").select("api_key")
    alone = ended.join(several, "api_key", "left_anti").groupBy("api_key", "username", "ends").agg(F.min("seq").alias("seq"))
    mixed = (
        ended.join(several, "api_key", "left_semi").repartition("api_key").sortWithinPartitions("api_key", "seq")
        .mapInPandas(keylife.lives, "api_key string, username string, seq long, ends long")
    )
    return alone.select("api_key", "username", "seq", "ends").unionByName(mixed)


def change_counts(users: DataFrame, changes: DataFrame) -> DataFrame:
    """(seq, op, affected): how many keys each change of the log touched.

    A change of a key looks at the key's latest life before it.  A change of a
    name counts the lives of that name that have begun less those that ended.
    """
    deletes, adds = changes.where(F.col("op") == "delete"), changes.where(F.col("op") == "add")
    lives = materialize(key_lives(_adds(users, changes), deletes))
    one, zero, none = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("long")

    added = adds.select("seq", "op", "api_key").join(
        lives.select("api_key", "seq", one.alias("_born")), ["api_key", "seq"], "left")
    added = added.select("seq", "op", F.coalesce("_born", zero).alias("affected"))

    writable = F.lit(False)
    for name in UPDATABLE:
        writable = writable | F.coalesce(F.map_contains_key("fields", name), F.lit(False))
    effect = F.when((F.col("op") == "update") & ~writable, zero).otherwise(one)
    others = changes.where(F.col("op") != "add").withColumn("_effect", effect)

    keyed = others.where(_has_key()).select("api_key", "seq", "op", "_effect", none.alias("_ends"))
    begun = lives.select("api_key", "seq", F.lit(None).cast("string").alias("op"), zero.alias("_effect"),
                         F.coalesce("ends", F.lit(2**62)).alias("_ends"))
    seen = last_before(keyed.unionByName(begun), ["api_key"], "seq", "_ends", "_until", LOG_SLICE)
    keyed = seen.where(F.col("op").isNotNull()).select(
        "seq", "op", F.when(F.col("_until") >= F.col("seq"), F.col("_effect")).otherwise(zero).alias("affected"))

    named = others.where(~_has_key()).select(
        "username", "seq", F.lit(0).alias("_after"), zero.alias("_step"), "op", "_effect")
    steps = lives.select("username", F.inline(F.array(
        F.struct("seq", F.lit(0).alias("_after"), one.alias("_step")),
        # A deletion still sees the keys it ends.
        F.struct(F.col("ends").alias("seq"), F.lit(1).alias("_after"), (-one).alias("_step")))))
    steps = steps.where(F.col("seq").isNotNull()).withColumns(
        {"op": F.lit(None).cast("string"), "_effect": zero})
    counted = running_before(named.unionByName(steps), ["username"], ["seq", "_after"],
                             {"_step": "_alive"}, LOG_SLICE)
    named = counted.where(F.col("op").isNotNull()).select(
        "seq", "op", (F.col("_alive") * F.col("_effect")).alias("affected"))
    return added.unionByName(keyed).unionByName(named)


def _latest(changes: DataFrame, key: str, prefix: str) -> DataFrame:
    """Last write per column for one way of addressing: {prefix}_{column} = (seq, value)."""
    written = []
    for name, kind in UPDATABLE.items():
        present = (F.col("op") == "update") & F.map_contains_key("fields", name)
        value = F.try_element_at("fields", F.lit(name)).cast(kind)
        written.append(F.max(F.when(present, F.struct("seq", value.alias("value")))).alias(f"{prefix}_{name}"))
    switch = F.col("op").isin("enable", "disable")
    enabled = F.when(F.col("op") == "enable", 1).otherwise(0)
    written.append(F.max(F.when(switch, F.struct("seq", enabled.alias("value")))).alias(f"{prefix}_enabled"))
    return changes.groupBy(key).agg(*written)


def apply_user_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users after the whole log.  Adding a key that exists has no effect."""
    alive = _effective_adds(_adds(users, changes), changes)
    keyed, named = changes.where(_has_key()), changes.where(~_has_key())
    joined = (
        alive.join(_latest(keyed, "api_key", "_key"), "api_key", "left")
        .join(_latest(named, "username", "_name"), "username", "left")
    )
    final = {}
    for name in ("enabled", *UPDATABLE):
        # The first value counts from the add on, later writes replace it.
        newest = F.greatest(*[
            F.struct("seq", F.col(name).alias("value")),
            *[F.when(F.col(f"{way}_{name}.seq") > F.col("seq"), F.col(f"{way}_{name}"))
              for way in ("_key", "_name")]])
        final[name] = newest["value"]
    return conform(joined.withColumns(final), USERS)


def duplicate_adds(users: DataFrame, new_users: DataFrame) -> DataFrame:
    """New users that cannot be added because their key exists or comes twice."""
    twice = new_users.groupBy("api_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    taken = new_users.join(users.select("api_key"), "api_key", "left_semi")
    return taken.unionByName(new_users.join(twice, "api_key", "left_semi")).distinct()


def add_users(users: DataFrame, new_users: DataFrame) -> DataFrame:
    """Users with the new keys appended; keys that exist are left as they are."""
    fresh = conform(new_users, USERS).join(users.select("api_key"), "api_key", "left_anti")
    return conform(users, USERS).unionByName(conform(fresh, USERS))


def auto_register(users: DataFrame, traffic: DataFrame, now_ms: int) -> DataFrame:
    """Rows for the non-empty keys seen in traffic that no user has."""
    keys = traffic.where(F.coalesce("api_key", F.lit("")) != "").select("api_key").distinct()
    unknown = keys.join(users.select("api_key"), "api_key", "left_anti")
    return conform(unknown.select(
        "api_key", auto_username("api_key").alias("username"), F.lit(1).alias("enabled"),
        F.lit(now_ms).alias("created_at"), F.lit(NOTE_AUTO).alias("note")), USERS)


def seed_user(users: DataFrame, api_key: str, now_ms: int) -> DataFrame:
    """Users with the shared transition account added if its key is absent."""
    if not api_key:
        return conform(users, USERS)
    known = users.agg(F.coalesce(F.bool_or(F.col("api_key") == api_key), F.lit(False)).alias("_known"))
    seed = known.where("NOT _known").select(
        F.lit(api_key).alias("api_key"), F.lit(NAME_LEGACY).alias("username"),
        F.lit(1).alias("enabled"), F.lit(now_ms).alias("created_at"), F.lit(NOTE_LEGACY).alias("note"))
    return conform(users, USERS).unionByName(conform(seed, USERS))
