"""All reports of a page or a command from one scan of the ledger."""

from datetime import date

from pyspark.sql import DataFrame

from usagelens.plans import ranking, reports, reshape
from usagelens.plans.cube import stored_cube
from usagelens.plans.filters import in_scope, rolling_days, select_usage


def dashboard(usage: DataFrame, as_of: date, tz: str, name: str = "period",
              username: str | None = None, newest: int | None = 30) -> dict[str, DataFrame]:
    """Reports of the statistics page for one range and scope, day by day for the ``newest`` days (None: all).

    The ledger is aggregated once to the cube, which is stored in the shared
    folder; every report merges from it.
    """
    cube = stored_cube(select_usage(usage, as_of, name, username), tz)
    users, models = reports.by_user(cube), reports.by_model(cube)
    families = reshape.pivot_user_family(cube)
    found = {
        "summary": reports.summary(cube),
        "by_user": users,
        "by_day": reports.by_day(cube, newest),
        "by_model": models,
        "by_user_client": reports.by_user_client(cube),
        "by_user_model": reports.by_user_model(cube),
        "by_day_user": reports.by_day_user(cube),
        "by_day_user_model": reports.by_day_user_model(cube),
        "by_day_hour_user": reports.by_day_hour_user(cube, tz),
        "by_hour_of_day": reports.by_hour_of_day(cube, tz),
        "pivot_user_family": families,
        "active_families": reshape.active_buckets(families, reshape.family_names()),
        "pivot_user_client": reshape.pivot_user_client(cube),
        "series_total": reshape.series_total(cube, newest),
        "series_user_day": reshape.series_user_day(cube, scoped=bool(username), newest=newest),
        "series_user_model_day": reshape.series_user_model_day(cube, newest),
        "series_model_user_day": reshape.series_model_user_day(cube, newest),
        "grid_day_hour_user": reshape.grid_day_hour_user(cube, tz),
        "hours_dense": reshape.hours_dense(cube, tz),
        "model_share": ranking.share_of_total(ranking.chart_totals(models, "model"), "cost_micros"),
        "rank_users": ranking.rank_users(ranking.chart_totals(users, "username")),
    }
    if username:
        found["today_hours"] = reshape.today_hour_scoped(cube, as_of, tz, username)
    else:
        found["today_hours"] = reshape.today_hour_cube(cube, as_of, tz)
    return found


def command_report(usage: DataFrame, now_ms: int, tz: str, days: float | None = None,
                   username: str | None = None, newest: int | None = 30) -> dict[str, DataFrame]:
    """Reports of the command line: a rolling range, tokens by day and user in long form.

    Reports by day have the ``newest`` days; None means all.
    """
    cube = stored_cube(rolling_days(in_scope(usage, username), now_ms, days, tz), tz)
    found = {
        "by_user": reports.by_user(cube),
        "by_day": reports.by_day(cube, newest),
        "by_model": reports.by_model(cube),
        "by_user_model": reports.by_user_model(cube, label=False),
        "pivot_user_family": reshape.pivot_user_family(cube),
        "pivot_user_client": reshape.pivot_user_client(cube),
    }
    if not username:
        found["day_user_matrix"] = reshape.day_user_matrix(cube, newest)
    return found
