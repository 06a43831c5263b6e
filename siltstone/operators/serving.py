"""What a question-answering service checks, remembers and sends, as rows: requests, messages with their history, answer events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import messages as S
from siltstone.functions import text as T
from siltstone.operators.memory import MAX_TURNS

#: What a request and a remembered turn may hold, fixed values.
QUESTION_CHARS, TICKER_CHARS, THREAD = 2000, 10, "^[A-Za-z0-9_-]{8,64}$"
TURN_QUESTION_CHARS, TURN_ANSWER_CHARS = 500, 1200
PREFACE = "What was said before on this thread, only to tell what the question refers to. Look up every figure again."


def request_problems(question: Column, ticker: Column, thread: Column) -> Column:
    """What is wrong with a request, by field (array of strings); a ticker and a thread may be left out."""
    length = F.coalesce(F.length(question), F.lit(0))
    return F.array_compact(
        F.array(
            F.when((length < 1) | (length > QUESTION_CHARS), "question"),
            F.when(F.coalesce(F.length(ticker) > TICKER_CHARS, F.lit(False)), "ticker"),
            F.when(thread.isNotNull() & ~F.coalesce(thread.rlike(THREAD), F.lit(False)), "thread_id"),
        )
    )


def composed_messages(turns: DataFrame, current: DataFrame, thread: str, order: str, limit: int = MAX_TURNS, preface: str = PREFACE) -> DataFrame:
    """(thread, message): what an agent is given for the ``current`` questions (thread, question).

    turns: (thread, order, question, answer). The last ``limit`` turns come first, clipped, oldest first; a thread without any gets its question alone.
    """
    back = F.row_number().over(W.partitionBy(thread).orderBy(F.desc(order)))
    kept = turns.withColumn("_back", back).where(F.col("_back") <= limit)
    turn = F.struct((-F.col("_back")).alias("b"), T.clip(F.coalesce("question", F.lit("")), TURN_QUESTION_CHARS).alias("q"), T.clip(F.coalesce("answer", F.lit("")), TURN_ANSWER_CHARS).alias("a"))
    held = kept.groupBy(thread).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))  # a few turns a thread
    number = lambda i: (i + 1).cast("string")
    line = lambda t, i: F.concat(F.lit("[Earlier turn "), number(i), F.lit("] Question: "), t["q"], F.lit("\n[Earlier turn "), number(i), F.lit("] Answer: "), t["a"], F.lit("\n"))
    history = F.concat(F.lit(preface + "\n\n"), F.array_join(F.transform("_turns", line), "\n"), F.lit("\nCurrent question:\n"), F.col("_question"))
    asked = current.select(thread, F.col("question").alias("_question"))
    return asked.join(held, thread, "left").select(thread, F.when(F.col("_turns").isNull(), F.col("_question")).otherwise(history).alias("message"))


def answer_events(answers: DataFrame, keys: list[str], marker: str) -> DataFrame:
    """(keys, seq, kind, payload): the events that send an answer, in order.

    answers: keys, answer, sources (array of struct), verification (struct), meta (struct). A usable answer goes out word by word, then what it stands
    on, how it was verified, what it cost, and the end; one that isn't usable is a single error event that says why.
    """
    event = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))
    words = F.transform(S.answer_words(F.col("answer")), lambda w: F.struct(F.lit("token").alias("kind"), w.alias("payload")))
    tail = F.array(event("sources", F.to_json("sources")), event("verification", F.to_json("verification")), event("meta", F.to_json("meta")), event("done", F.lit("")))
    outcome = T.terminal_state(F.col("answer"), marker)
    events = F.when(outcome.isNotNull(), F.array(event("error", outcome))).otherwise(F.concat(words, tail))
    rows = answers.select(*keys, F.posexplode(events).alias("seq", "e"))
    return rows.select(*keys, F.col("seq").cast("long").alias("seq"), "e.kind", "e.payload")
