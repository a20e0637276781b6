"""What a receiver says to each message of a stream: accepted, a repeat, another content under a known id, or too late.

A sender's messages are spread over shards by their id, so a busy sender is not one task's; all messages of one id meet in
the same shard. A shard's state is a cache of what it accepted, bounded in age and number; a shard that hears nothing for as
long as entries live forgets all of it.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "ids array<string>, created array<double>, digests array<string>"
RESULT = "seq bigint, message_id string, sender string, received_at timestamp, verdict string"


class Accepted:
    """Message ids with the time and digest under which they were accepted, the least recently met first."""

    def __init__(self, entries: list[tuple[str, float, str]], ttl: float, most: int):
        self.entries, self.ttl, self.most = OrderedDict((k, (at, d)) for k, at, d in entries), ttl, most

    def verdict(self, message: str, digest: str, now: float) -> str:
        """An entry lives for ttl seconds from when it was accepted, however often it is met; meeting it keeps it from being
        the first that goes when there are too many."""
        found = self.entries.get(message)
        if found is not None and found[0] >= now - self.ttl:
            if found[1] != digest:
                return "conflict"
            self.entries.move_to_end(message)
            return "repeat"
        self.entries[message] = (now, digest)
        self.entries.move_to_end(message)
        if len(self.entries) > self.most:
            gone = [k for k, (at, _) in self.entries.items() if at < now - self.ttl]
            for k in gone:
                del self.entries[k]
            while len(self.entries) > self.most:
                self.entries.popitem(last=False)
        return "accepted"


def replay_verdicts(messages: DataFrame, skew_seconds: float = 300.0, ttl_seconds: float = 600.0, most_entries: int = 4096, shards: int = 16, forget_idle: bool = True) -> DataFrame:
    """(seq, message_id, sender, received_at, verdict) of a stream of messages (seq, message_id, sender, sent_at, received_at,
    digest), in the order of received_at and then seq within a micro-batch.

    A message sent more than skew_seconds before or after it was received is expired and leaves no trace. A known id with the
    same digest is a repeat, with another digest a conflict. A shard remembers most_entries ids for ttl_seconds; an id that it
    forgot is accepted anew. Messages with a NULL in a column are malformed. With forget_idle a shard that hears nothing for
    ttl_seconds of the machine's time loses its state; Spark then runs batches for ever, so a run that is to end goes without.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = Accepted(list(zip(*state.get, strict=True)) if state.exists else [], ttl_seconds, most_entries)
        rows = pd.concat(list(frames)).sort_values(["received_at", "seq"], kind="stable")
        now = rows["received_at"].astype("datetime64[us]").astype("int64") / 1e6
        late = (now - rows["sent_at"].astype("datetime64[us]").astype("int64") / 1e6).abs() > skew_seconds
        broken = rows[["message_id", "sender", "sent_at", "received_at", "digest"]].isna().any(axis=1)
        verdicts = [
            "malformed" if bad else "expired" if old else known.verdict(m, d, at)
            for m, d, at, old, bad in zip(rows["message_id"], rows["digest"], now, late, broken, strict=True)
        ]
        state.update(tuple(list(column) for column in zip(*((k, at, d) for k, (at, d) in known.entries.items()), strict=True)) if known.entries else ([], [], []))
        if forget_idle:
            state.setTimeoutDuration(int(ttl_seconds * 1000))
        yield pd.DataFrame({"seq": rows["seq"], "message_id": rows["message_id"], "sender": rows["sender"], "received_at": rows["received_at"], "verdict": verdicts})

    plain = messages.select(
        F.col("seq").cast("bigint").alias("seq"), F.col("message_id").cast("string").alias("message_id"), F.col("sender").cast("string").alias("sender"),
        F.col("sent_at").cast("timestamp").alias("sent_at"), F.col("received_at").cast("timestamp").alias("received_at"), F.col("digest").cast("string").alias("digest"),
    )
    dealt = plain.withColumn("shard", F.pmod(F.xxhash64("message_id"), F.lit(shards)))
    return dealt.groupBy("sender", "shard").applyInPandasWithState(judge, RESULT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget_idle else GroupStateTimeout.NoTimeout)


def judged(messages: DataFrame, folder: str, **options) -> DataFrame:
    """The verdicts on all messages that a streaming source has now, written to and read from folder: one run of the stream
    until nothing is left, after which another run continues from its checkpoint."""
    spark = messages.sparkSession
    query = replay_verdicts(messages, forget_idle=False, **options).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/verdicts").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(RESULT).parquet(f"{folder}/verdicts")
