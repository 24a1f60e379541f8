"""Coarse labels of clients, models and accounts."""

from pyspark.sql import Column, functions as F

# Client classes, family names and account tags shown in reports.
CLIENTS = ["cli", "desktop", "other"]
FAMILIES = ["GPT", "Codex", "其他"]
FAMILY_COLUMNS = {"GPT": "gpt", "Codex": "codex", "其他": "other"}
TAG_TRANSITION, TAG_TEST = "过渡", "测试"
UNKNOWN_MODEL = "未知模型"

# Marks in a lower-cased User-Agent.
DESKTOP_MARKS = r"desktop|codex\.app"
CLI_MARKS = "codex|openai-python|openai-node"


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def client_class(user_agent) -> Column:
    """Client class of a User-Agent; the desktop test comes first."""
    agent = F.lower(_column(user_agent))
    return (
        F.when(agent.rlike(DESKTOP_MARKS), "desktop")
        .when(agent.rlike(CLI_MARKS), "cli")
        .otherwise("other")
    )


def model_family(model) -> Column:
    name = F.lower(_column(model))
    gpt, codex, other = FAMILIES
    return F.when(name.contains("codex"), codex).when(name.contains("gpt"), gpt).otherwise(other)


def client_bucket(client) -> Column:
    client = _column(client)
    return F.when(client.isin("cli", "desktop"), client).otherwise("other")


def user_tag(username) -> Column:
    """Marker of accounts that are not persons; NULL for all others."""
    name = _column(username)
    return F.when(name == "legacy", TAG_TRANSITION).when(name.startswith("auto-"), TAG_TEST)


def masked_key(api_key) -> Column:
    """A key as it may be shown: its last four characters, none of a short key."""
    key = _column(api_key)
    return F.concat(F.lit("***"), F.when(F.length(key) > 8, F.right(key, F.lit(4))).otherwise(""))


def caller_key(x_api_key, authorization) -> Column:
    """API key of a request: the key header if not empty, else the bearer token."""
    direct, auth = _column(x_api_key), _column(authorization)
    token = F.btrim(F.substring(auth, 8, 1 << 30), F.lit(" \t\n\r\x0b\x0c"))
    bearer = F.when(auth.startswith("Bearer "), token)
    return F.coalesce(F.nullif(direct, F.lit("")), bearer, F.lit(""))
