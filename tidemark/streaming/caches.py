"""Answers that expire: lookups over a dimension with a time to live, as a batch join and as keyed state on streams.

An answer (``key, ts, status, detail``) serves lookups (``ask_id, key, ts``) of its key from its own time on and until ``ttl``
seconds have passed. That nothing was found is an answer like others; answers of a status that isn't in ``KEPT``, such as
failures, are not kept. Of answers the latest counts, of equal times the one with the greater status, then detail.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Statuses of answers that are kept.
KEPT = ("FOUND", "NONE")
#: Parts that the time to live is cut into.
SLOTS = 8
FOUND = "ask_id long, key string, ts timestamp, status string, detail string, age double"


def _kept(answers: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    return answers.where(F.col("status").isin(*statuses) & F.col("key").isNotNull() & F.col("ts").isNotNull()).select("key", "ts", "status", "detail")


def _micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def looked_up(asks: DataFrame, answers: DataFrame, ttl: int, statuses: tuple[str, ...] = KEPT) -> DataFrame:
    """``ask_id, key, ts, status, detail, age``: what the cache says to each lookup; ``MISS`` and nulls where it has no answer.

    ``age`` is that of the answer in seconds. Time is cut into slots of an eighth of ``ttl``; the last answer of each slot is
    handed on to the slots that it may still serve. Lookups and answers are then sorted within (key, slot), so the work grows
    with the rows and a key that is asked all the time is spread over as many tasks as it has slots. Lookups without a key or
    a time are misses; rows that repeat count each.
    """
    width = max(1, ttl * 1_000_000 // SLOTS)
    slot = lambda c: F.floor(c / F.lit(width)).cast("long")
    known = _kept(answers, statuses).select("key", _micros("ts").alias("us"), "status", "detail").withColumn("slot", slot(F.col("us")))
    last = known.groupBy("key", "slot").agg(F.max(F.struct("us", "status", "detail")).alias("m"))
    later = last.select("key", F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + SLOTS + 1)).alias("slot"), "m.*")
    none = {"ask_id": F.lit(None).cast(asks.schema["ask_id"].dataType), "at": F.lit(None).cast(asks.schema["ts"].dataType), "asked": F.lit(0)}
    given = known.unionByName(later).select("key", "slot", "us", F.struct("us", "status", "detail").alias("answer"), *[c.alias(n) for n, c in none.items()])
    whole = F.col("key").isNotNull() & F.col("ts").isNotNull()
    asked = asks.where(whole).select("key", slot(_micros("ts")).alias("slot"), _micros("ts").alias("us"), F.lit(None).cast(given.schema["answer"].dataType).alias("answer"), "ask_id", F.col("ts").alias("at"), F.lit(1).alias("asked"))
    so_far = W.partitionBy("key", "slot").orderBy("us", "asked", "answer").rowsBetween(W.unboundedPreceding, W.currentRow)  # one key within an eighth of ttl
    told = given.unionByName(asked).withColumn("a", F.last("answer", ignorenulls=True).over(so_far)).where("asked = 1")
    fresh = F.col("us") - F.col("a.us") < F.lit(ttl * 1_000_000)
    of = lambda c: F.when(fresh, F.col(c))
    hit = told.select("ask_id", "key", F.col("at").alias("ts"), F.coalesce(of("a.status"), F.lit("MISS")).alias("status"), of("a.detail").alias("detail"), (F.when(fresh, F.col("us") - F.col("a.us")) / 1e6).alias("age"))
    none = lambda kind: F.lit(None).cast(kind)
    return hit.unionByName(asks.where(~whole).select("ask_id", "key", "ts", F.lit("MISS").alias("status"), none("string").alias("detail"), none("double").alias("age")))


class ExpiringAnswers(StatefulProcessor):
    """Lookups wait until the watermark has passed them, so that answers may come late; answers go when none can ask for them any more.

    A key has one timer, for what is due first of it. When it expires all that is due is dealt with, so state is read and
    written a few times for each key and trigger, however many rows it has.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answers = handle.getListState("answers", "us long, status string, detail string")
        self.asks = handle.getListState("asks", "ask_id long, us long")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, asks: list[tuple], answers: list[tuple]) -> int | None:
        """The first time at which a lookup is due or an answer of no use any more."""
        first = [min(x[1] for x in asks)] if asks else []
        first += [min(x[0] for x in answers) + self.ttl] if answers else []
        return min(first) // 1000 + 1 if first else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asks, answers = [], []
        text = lambda x: None if pd.isna(x) else x
        for part in rows:
            for ask, us, asked, status, detail in zip(*[part[c].tolist() for c in ("ask_id", "us", "asked", "status", "detail")], strict=True):
                if asked:
                    asks.append((ask, us))
                else:
                    answers.append((us, status, text(detail)))
        if asks:
            self.asks.appendList(asks)
        if answers:
            self.answers.appendList(answers)
        at, set_for = self._wake(asks, answers), self.timer.get()
        if at is not None and (set_for is None or at < set_for[0]):
            if set_for is not None:
                self.handle.deleteTimer(set_for[0])
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, answers = [tuple(x) for x in self.asks.get()], [tuple(x) for x in self.answers.get()]
        due, rest = sorted((x for x in waiting if x[1] < passed), key=lambda x: x[1]), [x for x in waiting if x[1] >= passed]
        known = sorted(answers, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or ""))
        out, at = [], 0
        for ask, us in due:
            while at < len(known) and known[at][0] <= us:
                at += 1
            hit = known[at - 1] if at and us - known[at - 1][0] < self.ttl else None
            out.append((ask, key[0], pd.Timestamp(us, unit="us"), hit[1] if hit else "MISS", hit[2] if hit else None, (us - hit[0]) / 1e6 if hit else None))
        left = [x for x in answers if x[0] + self.ttl > passed]
        for state, before, now in ((self.asks, waiting, rest), (self.answers, answers, left)):
            if not now:
                state.clear()
            elif len(now) < len(before):
                state.put(now)
        if (wake := self._wake(rest, left)) is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(wake)
            self.timer.update((wake,))
        if out:
            yield pd.DataFrame(out, columns=["ask_id", "key", "ts", "status", "detail", "age"]).astype({"age": "float64"})

    def close(self) -> None:
        pass


def looked_up_stream(asks: DataFrame, answers: DataFrame, ttl: int, statuses: tuple[str, ...] = KEPT) -> DataFrame:
    """The same of two streams with watermarks on ``ts``: each lookup is answered once, when the watermark has passed it.

    State of a key are its answers of the last ``ttl`` seconds and the lookups that wait. Rows without a key or a time are
    left out, since no watermark passes them. The session needs ``conversation.STATE_STORE``'s provider.
    """
    given = _kept(answers, statuses).select("key", "ts", F.lit(0).cast("long").alias("ask_id"), _micros("ts").alias("us"), F.lit(False).alias("asked"), "status", "detail")
    none = F.lit(None).cast("string")
    asked = asks.where("key is not null and ts is not null").select("key", "ts", F.col("ask_id").cast("long").alias("ask_id"), _micros("ts").alias("us"), F.lit(True).alias("asked"), none.alias("status"), none.alias("detail"))
    return given.unionByName(asked).groupBy("key").transformWithStateInPandas(ExpiringAnswers(ttl), FOUND, "Append", "EventTime")
