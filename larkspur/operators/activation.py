"""Early behaviour that tells who stays: single events by frequency, and pairs of events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from larkspur.functions.statistics import chi_square, chi_square_cut, matthews, p_values
from larkspur.functions.text import finite
from larkspur.schema import identified, normalize_events
from larkspur.session import shared_folder

# Events that say nothing about a product's use.
TRIVIAL = ("pageview", "$pageview", "page_view", "click", "$click", "session_start", "$session_start", "session_end", "identify", "$identify", "signup", "sign_up", "$create_alias")
#: Events that are paired: those with most adopters.
PAIRED = 30
MIN_LIFT = 1.1


def early_patterns(events: DataFrame, window: int = 7, retention: int = 30, trivial: tuple[str, ...] = TRIVIAL) -> DataFrame:
    """user_id, first, last, retained, names (event_name and n of each event inside the window) of every user.

    retained: active ``retention`` or more days after the first day, by any event. The window has its last
    day. Events are folded to days first; the user's first and last day and the counts by name then need no
    shuffle but the one to the user.
    """
    days = identified(normalize_events(events)).groupBy("user_id", "event_name", "event_date").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("user_id")
    spanned = days.withColumns({"first": F.min("event_date").over(own), "last": F.max("event_date").over(own)})
    early = F.col("event_name").isNotNull() & ~F.col("event_name").isin(*trivial) & (F.date_diff("event_date", "first") <= window)
    named = spanned.groupBy("user_id", "event_name").agg(F.first("first").alias("first"), F.first("last").alias("last"), F.sum(F.when(early, F.col("n"))).alias("n"))
    kept = F.collect_list(F.when(F.col("n") > 0, F.struct("event_name", "n")))
    users = named.groupBy("user_id").agg(F.first("first").alias("first"), F.first("last").alias("last"), kept.alias("names"))
    return users.withColumn("retained", (F.date_diff("last", "first") >= retention).cast("int"))


def _singles(users: DataFrame, frequencies: list[int]) -> DataFrame:
    """event_name, frequency, adopters, adopters_retained, since, until of events, and in the row without a name of all users.

    One pass over the users, cut off by a checkpoint: a row for each name and frequency.
    """
    shared_folder(users.sparkSession)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("event_name"), F.lit(0).alias("frequency")))
    steps = F.array(*[F.lit(t) for t in frequencies])
    reached = F.flatten(F.transform("names", lambda e: F.transform(F.filter(steps, lambda t: e["n"] >= t), lambda t: F.struct(e["event_name"].alias("event_name"), t.alias("frequency")))))
    rows = users.select("retained", "first", "last", F.explode(F.concat(whole, reached)).alias("at"))
    return rows.groupBy("at.event_name", "at.frequency").agg(F.count(F.lit(1)).alias("adopters"), F.sum("retained").alias("adopters_retained"), F.min("first").alias("since"), F.max("last").alias("until")).checkpoint()


def _analyse(events: DataFrame, window: int, retention: int, max_combinations: int, frequencies: list[int] | None, trivial: tuple[str, ...]) -> tuple[DataFrame, Row | None]:
    """(patterns with their 2 x 2 tables and statistics, the row of all users); the events are read once for singles, once for pairs."""
    users, frequencies = early_patterns(events, window, retention, trivial), frequencies or [1, 2, 3, 5, 10]
    singles = _singles(users, sorted({1, *frequencies}))
    every = singles.filter("event_name is null").first()
    named = singles.filter(F.col("event_name").isNotNull())
    out = named.filter(F.col("frequency").isin(*frequencies)).select(F.array("event_name").alias("events"), "frequency", "adopters", "adopters_retained")
    if max_combinations >= 2:
        most = [r["event_name"] for r in named.filter("frequency = 1").orderBy(F.desc("adopters"), "event_name").limit(PAIRED).collect()]
        # At most PAIRED names a user: one array, whose ordered pairs need no self-join.
        sets = users.select("retained", F.array_sort(F.transform(F.filter("names", lambda e: e["event_name"].isin(*most)), lambda e: e["event_name"])).alias("names"))
        pair = F.explode(F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, PAIRED), lambda b: F.array(a, b)))))
        both = sets.select("retained", pair.alias("events")).groupBy("events").agg(F.count(F.lit(1)).alias("adopters"), F.sum("retained").alias("adopters_retained"))
        out = out.unionByName(both.select("events", F.lit(1).alias("frequency"), "adopters", "adopters_retained"))
    out = out.withColumns({"users": F.lit(every["adopters"] if every else 0).cast("long"), "users_retained": F.lit(every["adopters_retained"] if every else 0).cast("long")})
    out = out.withColumn("others", F.col("users") - F.col("adopters")).withColumn("others_retained", F.col("users_retained") - F.col("adopters_retained"))
    a, ar, b, br = (F.col(c) for c in ("adopters", "adopters_retained", "others", "others_retained"))

    def rate(yes: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(yes, n), F.lit(0.0))

    lift = F.when(br > 0, rate(ar, a) / F.when(br > 0, rate(br, b)).otherwise(1.0)).when(ar > 0, F.lit(float("inf"))).otherwise(1.0)
    out = out.withColumns(
        {"adopter_rate": rate(ar, a), "other_rate": rate(br, b), "adoption": rate(a, F.col("users")), "lift": lift, "chi2": chi_square(ar, a, br, b), "mcc": matthews(ar, a - ar, br, b - br)}
    )
    return out.withColumn("p_value", p_values(F.col("chi2"))), every


def contingency(events: DataFrame, window: int = 7, retention: int = 30, max_combinations: int = 2, frequencies: list[int] | None = None, trivial: tuple[str, ...] = TRIVIAL) -> DataFrame:
    """Every pattern with its 2 x 2 table against all users, chi2, p_value, mcc, rates and lift."""
    return _analyse(events, window, retention, max_combinations, frequencies, trivial)[0]


def discover(events: DataFrame, window: int = 7, retention: int = 30, max_combinations: int = 2, max_results: int = 20, min_adopters: int = 10, min_non_adopters: int = 10, max_adoption: float = 0.95, min_adoption: float = 0.02, p_threshold: float = 0.05, frequencies: list[int] | None = None, trivial: tuple[str, ...] = TRIVIAL) -> DataFrame:
    """Significant patterns, best Matthews correlation first; of an event set the best frequency only.

    The test is strict (p < threshold), made on the statistic itself; a tie goes to the lower
    frequency. Sets of more than two events are not formed.
    """
    rows, _ = _analyse(events, window, retention, max_combinations, frequencies, trivial)
    return _significant(rows, max_results, min_adopters, min_non_adopters, max_adoption, min_adoption, p_threshold)


def _significant(rows: DataFrame, max_results: int = 20, min_adopters: int = 10, min_non_adopters: int = 10, max_adoption: float = 0.95, min_adoption: float = 0.02, p_threshold: float = 0.05) -> DataFrame:
    rows = rows.filter((F.col("adopters") >= min_adopters) & (F.col("others") >= min_non_adopters) & F.col("adoption").between(min_adoption, max_adoption) & (F.col("lift") >= MIN_LIFT) & (F.col("chi2") > chi_square_cut(p_threshold)))
    best = F.row_number().over(Window.partitionBy("events").orderBy(F.desc("mcc"), "frequency"))
    return rows.withColumn("_n", best).filter("_n = 1").drop("_n").orderBy(F.desc("mcc"), "events").limit(max_results)


def label(names: list[str], frequency: int) -> str:
    return f"{' + '.join(names)} ≥{frequency} time{'s' if frequency > 1 else ''}"


def impact_score(lift: float, adoption: float) -> float:
    return (lift - 1) * (1 - adoption)


def activation_summary(events: DataFrame, window: int = 7, retention: int = 30, max_combinations: int = 2, frequencies: list[int] | None = None, trivial: tuple[str, ...] = TRIVIAL, **options) -> dict:  # noqa: ANN003
    """The JSON form, ten moments at most; totals and dates come from the pass that counts single events."""
    rows, every = _analyse(events, window, retention, max_combinations, frequencies, trivial)
    found = _significant(rows, **options).collect()  # at most max_results rows
    n = every["adopters"] if every else 0
    base = every["adopters_retained"] / n if n else 0.0
    span = {"start": str(every["since"] if every else date.today()), "end": str(every["until"] if every else date.today())}

    def moment(r) -> dict:  # noqa: ANN001
        lifted = base + (1 - r["adoption"]) * (r["adopter_rate"] - r["other_rate"])
        return {
            "label": label(r["events"], r["frequency"]), "events": r["events"], "frequency": r["frequency"], "adopters": r["adopters"], "adoption_rate": round(r["adoption"], 4), "adopter_retention": round(r["adopter_rate"], 4), "non_adopter_retention": round(r["other_rate"], 4),
            "lift": finite(r["lift"], 2), "mcc": round(r["mcc"], 4), "p_value": r["p_value"], "impact_score": finite(impact_score(r["lift"], r["adoption"]), 4), "projected_impact": round(max(0.0, lifted - base), 4),
        }

    return {
        "metric": "activation_discovery", "caveat": "Association, not cause: confirm with an experiment.", "date_range": span, "total_users": n, "activation_window_days": window, "retention_period_days": retention,
        "baseline_retention": round(base, 4), "moments_found": len(found), "top_moments": [moment(r) for r in found[:10]],
    }
