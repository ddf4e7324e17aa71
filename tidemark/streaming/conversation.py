"""Conversations as keyed state: what was said last of each code, and how many questions were asked."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.evaluation import rank_within

#: Questions that a conversation may ask.
FOLLOW_UPS = 6


def folded(found: DataFrame) -> DataFrame:
    """A stream of ``conv, turn, code, negated`` to a row for each conversation and trigger: its codes as they stand (update mode).

    ``positive`` and ``negated_codes`` are sorted lists; the later turn decides, and within a turn a denial; ``asked``
    counts the turns that named nothing new, up to the limit. State holds what was said in each turn of a conversation,
    once; all of it is folded anew for the conversations of a trigger, so turns that come late count where they belong.
    """
    said = found.groupBy("conv").agg(F.sort_array(F.collect_set(F.struct("turn", "negated", "code"))).alias("said"))
    codes = F.array_distinct(F.transform("said", lambda x: x["code"]))
    last = lambda c: F.element_at(F.filter("said", lambda x: x["code"] == c), -1)["negated"]
    first = lambda c: F.element_at(F.filter("said", lambda x: x["code"] == c), 1)["turn"]
    turns = F.size(F.array_distinct(F.transform("said", lambda x: x["turn"]))) - F.size(F.array_distinct(F.transform("codes", first)))
    standing = said.withColumn("codes", F.sort_array(codes))
    return standing.select("conv", F.filter("codes", lambda c: ~last(c)).alias("positive"), F.filter("codes", last).alias("negated_codes"), F.least(F.lit(FOLLOW_UPS), turns).cast("int").alias("asked"))


#: Whole answers that affirm or deny what was asked, and beginnings that turn down what was suggested.
YES = ("yes", "yes i do", "yes i have", "yes i am", "i do", "i have", "i am", "correct", "yeah", "yep", "yup", "sure")
NO = ("no", "no i do not", "no i don't", "no i dont", "i do not", "i don't", "i dont", "not really", "negative", "nope")
REJECTION = r"(?i)^(no|nope|nah|none|not really|nothing like that|no issues?( related to .*)?|none of (these|those|the above)|not that|doesn'?t apply|not applicable|negative)\b"


def short_answer(text: Column) -> Column:
    """``yes`` or ``no`` for a reply of at most seven words that only affirms or denies; null for any other text."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), r"[^a-z0-9']+", " "), " +", " "))
    few = (plain != "") & (F.size(F.split(plain, " ")) <= 7)
    yes, no = plain.isin(*YES) | plain.rlike(r"^(yes|yeah|yep|yup|sure)\b"), plain.isin(*NO) | plain.rlike(r"^(no|nope)\b")
    return F.when(few & yes, "yes").when(few & no, "no")


def rejects(text: Column) -> Column:
    """Whether a reply of at most six words turns down what was suggested."""
    said = F.trim(F.coalesce(text, F.lit("")))
    return (F.size(F.split(said, r"\s+")) <= 6) & said.rlike(REJECTION)


@dataclass
class Dialogue:
    """What a conversation has come to: codes as last said, what was asked, suggested and turned down, and what waits for an answer."""

    said: dict[str, bool] = field(default_factory=dict)
    asked: dict[str, int] = field(default_factory=dict)
    suggested: list[str] = field(default_factory=list)
    declined: set[str] = field(default_factory=set)
    pending: str | None = None
    turns: int = 0

    def take(self, turn: int, answer: str | None, rejected: bool, positive: list[str], negative: list[str], question: str | None, suggestions: list[str], blank: bool) -> None:
        """One message and the reply to it. Blank messages, and those after the last question's limit, change nothing.

        A rejection of suggestions declines them and says nothing else. A short answer goes to the pending question alone;
        any other message sets its codes, a denial after an affirmation in one message, and settles the pending question
        if it names that code. The reply's question waits unless its code was asked before; its suggestions are those not
        declined.
        """
        if blank or len(self.asked) > FOLLOW_UPS:
            return
        self.turns += 1
        before, self.suggested = self.suggested, []
        if before and rejected:
            self.declined.update(before)
        elif self.pending and answer:
            self.said[self.pending] = answer == "yes"
            self.pending = None
        else:
            self.said.update(dict.fromkeys(positive, True) | dict.fromkeys(negative, False))
            if self.pending in self.said:
                self.pending = None
        if question and question not in self.asked:
            self.asked[question] = turn
            self.pending = question
        self.suggested = [c for c in suggestions if c not in self.declined]

    def row(self, key) -> pd.DataFrame:
        lists = {"positive": sorted(c for c, x in self.said.items() if x), "negative": sorted(c for c, x in self.said.items() if not x), "asked": sorted(self.asked), "suggested": self.suggested, "declined": sorted(self.declined)}
        return pd.DataFrame({"conv": [key], **{k: [v] for k, v in lists.items()}, "pending": [self.pending], "turns": [self.turns]})


#: Of the messages that ``Dialogue`` takes, and of what it comes to.
MESSAGES = "conv long, turn long, answer string, rejected boolean, positive array<string>, negative array<string>, question string, suggestions array<string>, blank boolean"
DIALOGUES = "conv long, positive array<string>, negative array<string>, asked array<string>, suggested array<string>, declined array<string>, pending string, turns long"


def _take_all(dialogue: Dialogue, rows: pd.DataFrame) -> None:
    listed = lambda x: [] if x is None else list(x)
    for r in rows.sort_values("turn").itertuples(index=False):
        text = lambda x: None if pd.isna(x) else x
        dialogue.take(int(r.turn), text(r.answer), bool(r.rejected), listed(r.positive), listed(r.negative), text(r.question), listed(r.suggestions), bool(r.blank))


class DialogueProcessor(StatefulProcessor):
    """``Dialogue`` as state with a variable for each part, each of which is forgotten ``ttl`` after it was last written."""

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getMapState("said", "code string", "positive boolean", self.ttl)
        self.asked = handle.getMapState("asked", "code string", "turn long", self.ttl)
        self.declined = handle.getMapState("declined", "code string", "yes boolean", self.ttl)
        self.suggested = handle.getListState("suggested", "code string", self.ttl)
        self.last = handle.getValueState("last", "pending string, turns long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = Dialogue({k[0]: v[0] for k, v in self.said.iterator()}, {k[0]: v[0] for k, v in self.asked.iterator()}, [x[0] for x in self.suggested.get()], {k[0] for k in self.declined.keys()}, *(self.last.get() if self.last.exists() else (None, 0)))
        before = dict(d.said), set(d.asked), set(d.declined)
        _take_all(d, pd.concat(list(rows)))
        for code, positive in d.said.items():
            if before[0].get(code) is not positive:
                self.said.updateValue((code,), (positive,))
        for code in d.asked.keys() - before[1]:
            self.asked.updateValue((code,), (d.asked[code],))
        for code in d.declined - before[2]:
            self.declined.updateValue((code,), (True,))
        self.suggested.clear()
        if d.suggested:
            self.suggested.put([(c,) for c in d.suggested])
        self.last.update((d.pending, d.turns))
        yield d.row(key[0])

    def close(self) -> None:
        pass


def dialogues(messages: DataFrame, ttl: int | None = None) -> DataFrame:
    """A stream of ``MESSAGES`` to a row for each conversation and trigger: what it has come to.

    Messages of a conversation are taken in the order of turns within a trigger; those of a turn must come in one. State
    lives in RocksDB (``STATE_STORE``), part by part, so a trigger reads and writes only what belongs to its conversations;
    parts are forgotten ``ttl`` milliseconds after they were last written, never without it. A restart goes on from the
    checkpoint.
    """
    return messages.groupBy("conv").transformWithStateInPandas(DialogueProcessor(ttl), DIALOGUES, "Update", "ProcessingTime" if ttl else "None")


#: What a session needs for ``dialogues``; with a ``ttl`` triggers without data would follow each other without end.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in the provider of ``STATE_STORE``; the session's own setting comes back behind it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE[name])
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def dialogues_of(messages: DataFrame) -> DataFrame:
    """The same of a whole table; the messages of a conversation are few."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = Dialogue()
        _take_all(d, rows)
        return d.row(key[0])

    return messages.groupBy("conv").applyInPandas(fold, DIALOGUES)


def last_messages(messages: DataFrame, keep: int = 50, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``keep`` messages of each conversation, in order, as one array."""
    last = rank_within(messages.select(key, turn, "role", "text"), [key], [F.desc(turn)]).where(F.col("rank") <= keep)  # kept before the shuffle
    return last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(turn, "role", "text"))).alias("messages"))
