"""Product lifecycle by manifests of complete crawls: active, discontinued, review, archived; as a batch and as a stream.

A check has one effect: ``active`` or ``discontinued`` (the card was read), ``http`` (the address is gone) or ``variant`` (a
fully read card lacks the variant). A manifest says whether a run read all navigation of a source; without a complete one
no absence counts. An absence within a day of the last that counted is ignored. The second in a row of the same kind
archives, the first of a kind sends to review. A product that no page of a complete manifest names is ``unlisted``: it goes
to review unless it is archived. A read card restores, and resets the count. Before its first read card a product is not
known, and nothing can be absent. Checks are taken in the order of (at, obs_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000
READ, ABSENT = ("active", "discontinued"), ("http", "variant")
#: Stands behind every check of the same time.
LAST = (1 << 63) - 1
STATE = "state string, missing int, kind string, last long, events int"


def manifests(pages: DataFrame) -> DataFrame:
    """(source, run_id, complete, closed) of pages(source, run_id, at, kind, ok): complete with at least one navigation page
    (sitemap or listing), all of them read, and at least one product page."""
    navigation = F.col("kind").isin("sitemap", "listing")
    out = pages.groupBy("source", "run_id").agg(F.count_if(navigation).alias("n"), F.count_if(F.col("kind") == "product").alias("p"), F.count_if(navigation & ~F.coalesce("ok", F.lit(False))).alias("open"), F.max("at").alias("closed"))
    return out.select("source", "run_id", ((F.col("n") > 0) & (F.col("p") > 0) & (F.col("open") == 0)).alias("complete"), "closed")


def gated(checks: DataFrame, runs: DataFrame) -> DataFrame:
    """checks(rule_id, source, run_id, at, obs_id, effect) without the absences that no complete manifest confirms."""
    done = runs.select("source", "run_id", "complete")
    j = checks.join(done, ["source", "run_id"], "left")
    return j.where(F.col("effect").isin(*READ) | (F.col("effect").isin(*ABSENT) & F.coalesce("complete", F.lit(False)))).select("rule_id", "at", "obs_id", "effect")


def unlisted(products: DataFrame, listed: DataFrame, runs: DataFrame) -> DataFrame:
    """A check of effect ``unlisted`` for every product(rule_id, source) and complete run of its source in which
    listed(rule_id, run_id) lacks it, at the time when the run closed."""
    due = products.join(runs.where("complete"), "source").select("rule_id", "run_id", F.col("closed").alias("at"))
    return due.join(listed.select("rule_id", "run_id").distinct(), ["rule_id", "run_id"], "left_anti").select("rule_id", "at", F.lit(LAST).alias("obs_id"), F.lit("unlisted").alias("effect"))


def _step(s: Column, x: Column) -> Column:
    """The state after one check, as columns."""
    read, absent = x["effect"].isin(*READ), x["effect"].isin(*ABSENT)
    late = s["last"].isNull() | (x["at"] - s["last"] >= DAY)
    counts = absent & (s["state"] != "new") & late
    missing = F.when(s["kind"] == x["effect"], s["missing"] + 1).otherwise(1)
    seen = (x["effect"] == "unlisted") & ~s["state"].isin("new", "archived") & late
    return F.struct(
        F.when(read, x["effect"]).when(counts, F.when(missing >= 2, "archived").otherwise("review")).when(seen, "review").otherwise(s["state"]).alias("state"),
        F.when(read, 0).when(counts, missing).otherwise(s["missing"]).alias("missing"),
        F.when(read, "").when(counts, x["effect"]).otherwise(s["kind"]).alias("kind"),
        F.when(counts, x["at"]).when(~read, s["last"]).alias("last"),
        (s["events"] + F.when(counts | (read & s["state"].isin("new", "archived")), 1).otherwise(0)).alias("events"),
    )


def fold(checks: DataFrame) -> DataFrame:
    """(rule_id, state, missing, kind, events) after all of gated() and unlisted() checks; products never read are ``new``.

    A card read again in the same state changes nothing and goes before checks are gathered, so a product's array holds its
    changes only.
    """
    w = Window.partitionBy("rule_id").orderBy("at", "obs_id")
    rows = checks.select("rule_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "obs_id", "effect").withColumn("before", F.lag("effect").over(w))
    rows = rows.where(~F.col("effect").isin(*READ) | ~F.col("effect").eqNullSafe(F.col("before")))
    start = F.struct(F.lit("new").alias("state"), F.lit(0).alias("missing"), F.lit("").alias("kind"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("events"))
    gathered = rows.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("at", "obs_id", "effect"))).alias("xs"))
    return gathered.select("rule_id", F.aggregate("xs", start, _step).alias("s")).select("rule_id", "s.state", "s.missing", "s.kind", "s.events")


def step(state: tuple, effect: str, at: int) -> tuple[tuple, str | None]:
    """The state after one check, and its event."""
    name, missing, kind, last, events = state
    if effect in READ:
        event = "discovered" if name == "new" else "restored" if name == "archived" else None
        return (effect, 0, "", None, events + (event is not None)), event
    if name == "new" or (last is not None and at - last < DAY):
        return state, None
    if effect == "unlisted":
        return (name if name == "archived" else "review", missing, kind, last, events), None
    missing = missing + 1 if kind == effect else 1
    name = "archived" if missing >= 2 else "review"
    return (name, missing, effect, at, events + 1), name


class CatalogueState(StatefulProcessor):
    """Holds checks until the watermark has passed them, then takes them in order: an event row for each change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.held = handle.getListState("held", "at long, obs_id long, effect string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for at, obs_id, effect in zip(pdf["at_us"], pdf.obs_id, pdf.effect, strict=True):
                self.held.appendValue((int(at), int(obs_id), effect))
                self.handle.registerTimer(int(at) // 1000 + 1)
        yield pd.DataFrame(columns=["rule_id", "obs_id", "event", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, rows = expiredTimerInfo.getExpiryTimeInMs(), list(self.held.get()) if self.held.exists() else []
        due, later = [r for r in rows if r[0] // 1000 < until], [r for r in rows if r[0] // 1000 >= until]
        state, out = tuple(self.state.get()) if self.state.exists() else ("new", 0, "", None, 0), []
        for at, obs_id, effect in sorted(map(tuple, due)):
            state, event = step(state, effect, at)
            if event:
                out.append((key[0], obs_id, event, state[0]))
        if due:
            self.state.update(state)
            self.held.put(later) if later else self.held.clear()
        yield pd.DataFrame(out, columns=["rule_id", "obs_id", "event", "state"])

    def close(self) -> None:
        pass


def events(checks: DataFrame, runs: DataFrame, lateness: str = "1 day", run_length: str = "2 days") -> DataFrame:
    """Streams of checks(rule_id, source, run_id, at, obs_id, effect) and of runs(source, run_id, complete, closed) -> a stream
    of (rule_id, obs_id, event, state). A check waits for its run's manifest, up to ``run_length``, and for all checks before
    it, up to ``lateness``; what comes later than that is dropped."""
    c = checks.withWatermark("at", lateness)
    r = runs.withWatermark("closed", lateness).select(F.col("source").alias("_source"), F.col("run_id").alias("_run"), "complete", "closed")
    j = c.join(r, F.expr(f"source = _source and run_id = _run and closed >= at and closed <= at + interval {run_length}"), "leftOuter")
    kept = j.where(F.col("effect").isin(*READ, "unlisted") | F.coalesce("complete", F.lit(False)))
    rows = kept.select("rule_id", "at", F.unix_micros("at").alias("at_us"), "obs_id", "effect")
    return rows.groupBy("rule_id").transformWithStateInPandas(statefulProcessor=CatalogueState(), outputStructType="rule_id long, obs_id long, event string, state string", outputMode="append", timeMode="eventTime")


def moved(cards: DataFrame, known: DataFrame, aliases: DataFrame, fetches: DataFrame) -> DataFrame:
    """cards(card_id, source, brand, article, url) that known(rule_id, source, brand, article, url) names once at another
    address, with rule_id and evidence: alias (the rule was seen there), redirect (the old address leads there), gone (the
    old address answers 404 or 410); without evidence null, and the card stays one of its own.

    aliases(rule_id, url) and fetches(url, status, target) are unique; null articles match nothing.
    """
    identity = ["source", "brand", "article"]
    once = known.groupBy(*identity).agg(F.count("*").alias("n"), F.min(F.struct("rule_id", F.col("url").alias("old"))).alias("k")).where("n = 1").select(*identity, "k.rule_id", "k.old")
    j = cards.join(once, identity).where("url <> old")
    j = j.join(aliases.select("rule_id", "url", F.lit(True).alias("alias")), ["rule_id", "url"], "left")
    j = j.join(fetches.select(F.col("url").alias("old"), F.col("status").alias("answer"), "target"), "old", "left")
    evidence = F.when(F.col("alias"), "alias").when((F.col("answer") == 200) & (F.col("target") == F.col("url")), "redirect").when(F.col("answer").isin(404, 410), "gone")
    return j.select("card_id", "rule_id", "url", evidence.alias("evidence"))
