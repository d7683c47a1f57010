"""Who gets a unique value, request by request.

Requests ask, in one total order, to give an owner a value that at most one owner may hold. A request is granted when
no other owner holds the value at that moment; the owner's former value is free from then on. A row-at-a-time system
gets this by doing one after the other. Here all requests are judged together, in steps that stay in Spark.

What needs no others is decided at first sight, by one row per value and owner. The rest falls into parts that share no
owner and no wanted value; small ones (or all of it, if it is no larger than a small part may be) are dealt to tasks,
which decide their requests one after the other. Large parts (a hot value, a long chain) are judged in rounds.

A round looks at spans: a granted request (or what an owner held before the batch) holds its value until the owner's
next grant of another one, an undecided request might. Running extremes per owner give each span's latest end (the next
grant for certain) and the undecided requests of the owner that might end it sooner; running extremes per value give
the spans that reach a request. Then

* a request is refused when a span that surely holds reaches it, and granted when none can;
* a granted span with a known end hands its value to the first request after that end, which hands it on: these chains
  are followed by pointer doubling;
* a request that one undecided request alone decides (the holder's wish to leave, or another's wish to come) has its
  outcome or the opposite: these chains are also followed by pointer doubling, to their decided ends.

The earliest undecided request is always certain, so rounds end. A chain of owners that wait for one another, however
long, and a value that passes through many hands take a few rounds with a logarithmic number of joins each.

Requests that wait for several undecided ones at once would take a round for each such dependency that lies behind
another (a few owners that want the same few values again and again). So the earliest undecided requests are also decided
in turns: a task gets a bounded number of rows, the earliest undecided requests with the grants between them and what
was held before, and goes through them in order. A turn decides as many requests as it holds, however they depend on
one another; rounds are tried again after 1, 2, 4, ... turns as long as they decide less than a turn.

All scans split hot values and hot owners over tasks (``scans``); a request meets at most two spans, never all of its
value. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convops.operators.dedup import order_key
from convops.operators.scans import in_runs, running
from convops.session import kept

#: Moments before and after those of all requests.
BEFORE, AFTER = Decimal(-(10 ** 38) + 1), Decimal(10 ** 38 - 1)


#: Rows of a part that one task decides one after the other, and the steps in which a part must be found.
SMALL_ROWS, LABEL_STEPS = 10_000, 3
#: Rows that one task goes through in a turn, batch by batch; it keeps who holds what.
TURN_ROWS = 500_000
#: Rows of a run that is scanned by one task.
RUN_ROWS = 100_000


def _moment(value: Decimal) -> Column:
    return F.lit(value).cast("decimal(38,0)")


def _ends(rows: DataFrame, parts: int) -> DataFrame:
    """Per row: ``end``, the owner's first grant of another value after it, and of the owner's undecided requests after
    it ``next`` (at, value, id, then: the one after that)."""
    group, order = ["owner"], "at"
    runs = in_runs(rows, group, order, parts)
    runs = running(runs, parts, group, order, {"held": F.when(F.col("granted"), F.struct("at", "value"))})
    changes = F.col("granted") & (F.col("held").isNull() | (F.col("held.value") != F.col("value")))
    open_ = F.col("granted").isNull()
    runs = running(runs, parts, group, order, {"change": F.when(changes, F.col("at")),
                                        "open": F.when(open_, F.struct("at"))}, largest=False, following=True)
    runs = running(runs, parts, group, order, {
        "grant": F.when(F.col("granted"), F.struct("at", "value", "change")),
        "next": F.when(open_, F.struct("at", "value", "id", F.col("open.at").alias("then")))},
        largest=False, following=True)
    end = (F.when(F.col("grant").isNull(), _moment(AFTER)).when(F.col("grant.value") != F.col("value"), F.col("grant.at"))
           .otherwise(F.coalesce("grant.change", _moment(AFTER))))
    return runs.select(*rows.columns, end.alias("end"), "next")


def _reached(ended: DataFrame, parts: int) -> DataFrame:
    """Per row the span of another owner that reaches furthest (``top``), the furthest of an owner other than that
    (``runner``), and the same among spans that surely hold."""
    group, order = ["value"], "at"
    runs = in_runs(ended, group, order, parts)
    possible = F.struct("end", "at", "owner", "granted", "id", "next")
    sure = F.when(F.col("granted"), F.struct(F.least("end", F.coalesce("next.at", "end")).alias("end"), "at", "owner"))
    runs = running(runs, parts, group, order, {"top": possible, "sure": sure})

    def loser(mine: Column, top: str) -> Column:
        return F.when(F.col(f"{top}.owner") != F.col("owner"), F.least(mine, F.col(top)))
    return running(runs, parts, group, order, {"runner": loser(possible, "top"), "sure_runner": loser(sure, "sure")}).drop("__run")


def _reaches(span: str) -> Column:
    return F.coalesce(F.col(f"{span}.end") > F.col("at"), F.lit(False))


def _by_other(top: str, runner: str) -> Column:
    return F.when(F.col(f"{top}.owner") == F.col("owner"), _reaches(runner)).otherwise(_reaches(top))


def _handed_on(judged: DataFrame, parts: int) -> DataFrame:
    """id of the undecided requests that surely granted spans with a known end hand their value to."""
    known = (F.col("end") < _moment(AFTER)) & F.coalesce(F.col("next.at") > F.col("end"), F.lit(True)) & ~F.col("shared")
    spans = judged.where(F.coalesce("verdict", F.lit(True)) & known)
    events = (judged.where("verdict IS NULL").select("value", "at", "id", F.lit(None).cast("long").alias("source"),
                                                     F.lit(False).alias("start"))
              .unionByName(spans.select("value", F.col("end").alias("at"), F.lit(None).cast("long").alias("id"),
                                        F.col("id").alias("source"), F.col("verdict").isNotNull().alias("start"))))
    # a grant in between takes the value too
    events = events.unionByName(judged.where("verdict").select(
        "value", "at", F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("source"), F.lit(False).alias("start")))
    group, order = ["value"], "at"
    is_request = F.col("source").isNull() & ~F.col("start")
    found = running(in_runs(events.withColumn("at", F.struct("at", "id", "source")), group, order, parts), parts, group, order,
                    {"after": F.when(is_request, F.struct("at.at", "id"))}, largest=False, following=True)
    edges = found.where(~is_request).select("source", "start", F.col("after.id").alias("target")).where("target >= 0")
    reached = kept(edges.where("start").select(F.col("target").alias("id")).distinct(), "claims")
    jumps = edges.where("NOT start").select("source", "target")
    size = reached.count()
    while size:
        more = reached.join(jumps, reached["id"] == jumps["source"]).select(F.col("target").alias("id"))
        reached = kept(reached.unionByName(more).distinct(), "claims")
        now = reached.count()
        if now == size:
            break
        size = now
        ahead = jumps.select(F.col("source").alias("target"), F.col("target").alias("further"))
        jumps = kept(jumps.join(ahead, "target").select("source", F.col("further").alias("target")), "claims")
    return reached


def _followed(judged: DataFrame) -> DataFrame:
    """id, outcome of the undecided requests whose outcome is that of one other request, or its opposite."""
    alone = ((F.col("top.owner") != F.col("owner")) & _reaches("top") & ~_reaches("runner"))
    stays = F.coalesce(F.col("top.next.at") > F.col("at"), F.lit(True))
    leaves = (~stays & (F.col("top.next.value") != F.col("value"))
              & F.coalesce(F.col("top.next.then") > F.col("at"), F.lit(True)))
    link = (F.when(alone & F.col("top.granted") & leaves, F.struct(F.col("top.next.id").alias("to"), F.lit(False).alias("flip")))
            .when(alone & F.col("top.granted").isNull() & stays, F.struct(F.col("top.id").alias("to"), F.lit(True).alias("flip"))))
    known = judged.where("asked AND verdict IS NOT NULL").select(F.col("id").alias("to"), "verdict")
    links = judged.where("verdict IS NULL").select("id", link.alias("link")).where("link IS NOT NULL").select("id", "link.*")
    links = kept(links.join(known, "to", "left"), "claims")
    while True:
        ahead = links.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("flip").alias("again"),
                             F.col("verdict").alias("its"))
        moved = (links.where("verdict IS NULL").drop("verdict").join(ahead, "to", "left")
                 .select(F.coalesce("further", "to").alias("to"), "id",
                         (F.col("flip") != F.coalesce("again", F.lit(False))).alias("flip"),
                         F.col("its").alias("verdict"), F.col("further").isNotNull().alias("on")))
        links = kept(links.where("verdict IS NOT NULL").withColumn("on", F.lit(False)).unionByName(moved), "claims")
        if not links.where("on").take(1):
            break
        links = links.drop("on")
    return links.where("verdict IS NOT NULL").select("id", (F.col("verdict") != F.col("flip")).alias("outcome"))


def _round(rows: DataFrame) -> DataFrame:
    """id, granted of the requests that this round decides. ``rows``: what is held or might be."""
    parts = 1 + rows.count() // RUN_ROWS
    seen = _reached(_ends(rows, parts), parts)
    own = (F.col("sure.owner") == F.col("owner")) & _reaches("sure")
    verdict = (F.when(F.col("granted"), True).when(_by_other("sure", "sure_runner"), False)
               .when(own | ~_by_other("top", "runner"), True))
    judged = kept(seen.withColumn("verdict", verdict).withColumn("asked", F.col("id").isNotNull()), "claims")
    certain = judged.where("granted IS NULL AND verdict IS NOT NULL").select("id", F.col("verdict").alias("granted"))
    if not judged.where("verdict IS NULL").take(1):
        return certain
    handed = _handed_on(judged.where("verdict IS NULL OR verdict"), parts).select("id", F.lit(True).alias("handed"))
    judged = kept(judged.join(handed, "id", "left").withColumn("verdict", F.coalesce("verdict", "handed")).drop("handed"),
                  "claims")
    certain = judged.where("granted IS NULL AND verdict IS NOT NULL").select("id", F.col("verdict").alias("granted"))
    return certain.unionByName(_followed(judged).select("id", F.col("outcome").alias("granted")))


def _at_first_sight(asked: DataFrame, held: DataFrame) -> DataFrame:
    """id, granted of the requests that need no span: the first one of a value that no other holds is granted, one for
    what somebody holds who has asked for nothing by then is refused. One row per value and owner meets the requests."""
    first_of_owner = asked.groupBy("owner").agg(F.min("at").alias("stirs"))
    first_of_value = asked.groupBy("value").agg(F.min("at").alias("first"))
    latest = F.max(F.struct(F.coalesce("stirs", _moment(AFTER)).alias("stirs"), F.col("owner").alias("holder")))
    per_value = (held.join(first_of_owner, "owner", "left").groupBy("value")
                 .agg(latest.alias("last"), F.count(F.lit(1)).alias("holders")))
    rows = asked.join(first_of_value, "value").join(per_value, "value", "left")
    other = F.col("last.holder") != F.col("owner")
    verdict = (F.when(other & (F.col("last.stirs") > F.col("at")), False)
               .when((F.col("holders").isNull() | (~other & (F.col("holders") == 1))) & (F.col("at") == F.col("first")), True))
    return rows.select("id", verdict.alias("granted")).where("granted IS NOT NULL")


def _one_by_one(rows: Iterable[tuple], held: dict, holders: dict) -> tuple[list[int], list[bool]]:
    """ids and outcomes of the undecided of ``rows`` (id, owner, value, granted) in their order. ``held``: owner -> value,
    ``holders``: value -> owners; both follow."""
    ids, outcomes = [], []
    for id_, owner, value, granted in rows:
        if pd.isna(granted):
            granted = not holders.get(value, set()) - {owner}
            ids.append(int(id_))
            outcomes.append(granted)
        if granted:
            holders.get(held.get(owner), set()).discard(owner)
            held[owner] = value
            holders.setdefault(value, set()).add(owner)
    return ids, outcomes


def grants_in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """id, granted of the undecided requests of a few rows that nothing else bears on, one after the other."""
    ordered = sorted(zip(rows["at"], rows["id"], rows["owner"], rows["value"], rows["granted"]), key=lambda r: r[0])
    ids, outcomes = _one_by_one((r[1:] for r in ordered), {}, {})
    return pd.DataFrame({"id": ids, "granted": outcomes}).astype({"id": "int64", "granted": "bool"})


def _grants_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same over batches of rows in their order; only who holds what is kept."""
    held: dict = {}
    holders: dict = {}
    for batch in batches:
        ids, outcomes = _one_by_one(zip(*(c.to_pylist() for c in batch.columns)), held, holders)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(outcomes, pa.bool_())], ["id", "granted"])


def _in_small_parts(rows: DataFrame, small_rows: int) -> DataFrame:
    """id, granted of the requests in parts that share no owner and no wanted value with others: those with at most
    ``small_rows`` rows that a few steps of the smallest label show to be whole. Other rows are left as they are."""
    live = rows.where("granted IS NULL").select("value", F.lit(True).alias("live")).distinct()
    marked = rows.join(live, "value", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    near = marked.where("live").select("owner").distinct()
    part = kept(marked.join(near, "owner", "left_semi")
                .withColumn("label", F.when(F.col("live"), F.xxhash64("value"))), "claims")

    def least(frame: DataFrame, by: str) -> DataFrame:
        own = frame.where("label IS NOT NULL").groupBy(by).agg(F.min("label").alias("least"))
        return (frame.join(own, by, "left").withColumn("label", F.coalesce("least", "label")).drop("least"))
    columns = ["label", "id", "owner", "value", "at", "granted"]
    if part.count() <= small_rows:  # all of them are small enough to be one part
        return (part.withColumn("label", F.lit(0)).select(columns)
                .groupBy("label").applyInPandas(grants_in_order, "id long, granted boolean"))
    for _ in range(LABEL_STEPS):
        by_owner = least(part, "owner")
        part = kept(least(by_owner.where("live"), "value").unionByName(by_owner.where("NOT live")), "claims")
    whole = part
    for by, some in (("owner", part), ("value", part.where("live"))):
        span = some.groupBy(by).agg(F.min("label").alias(f"{by}_low"), F.max("label").alias(f"{by}_high"))
        whole = whole.join(span, by, "left")
    same = ((F.col("owner_low") == F.col("owner_high"))
            & (~F.col("live") | (F.col("value_low") == F.col("value_high"))))
    closed = (whole.groupBy("label").agg(F.min(same.cast("int")).alias("same"), F.count(F.lit(1)).alias("n"))
              .where(f"same = 1 AND n <= {small_rows}").select("label"))
    return (part.join(closed, "label", "left_semi").select(columns)
            .groupBy("label").applyInPandas(grants_in_order, "id long, granted boolean"))


def _in_turn(rows: DataFrame, turn_rows: int) -> DataFrame:
    """id, granted of the earliest undecided requests: those among the first ``turn_rows`` rows from the earliest on. All
    that was asked before them is decided, so one task goes through them in order; of what is held before, it gets the
    values asked for: with their holders that move in this turn, and one of those that don't."""
    live = rows.where("granted IS NULL").select("value").distinct()
    near = rows.join(live, "value", "left_semi").select("owner").distinct()
    columns = ["id", "owner", "value", "at", "granted"]
    seen = kept(rows.join(near, "owner", "left_semi").select(columns), "claims")
    first = F.lit(seen.where("granted IS NULL").agg(F.min("at")).first()[0])
    ahead = seen.where(F.col("at") >= first)
    last = F.lit(ahead.select("at").orderBy("at").limit(turn_rows).agg(F.max("at")).first()[0])
    turn = kept(ahead.where(F.col("at") <= last), "claims")
    wanted = turn.where("granted IS NULL").select("value").distinct()
    moving = turn.select("owner", F.lit(True).alias("moves")).distinct()
    before = (seen.where(F.col("at") < first).groupBy("owner").agg(F.max(F.struct("at", "value")).alias("last"))
              .select("owner", "last.value").join(wanted, "value", "left_semi").join(moving, "owner", "left"))
    still = before.where("moves IS NULL").groupBy("value").agg(F.min("owner").alias("owner"))
    start = before.where("moves").select("owner", "value").unionByName(still).select(
        F.lit(None).cast("long").alias("id"), "owner", "value", _moment(BEFORE).alias("at"), F.lit(True).alias("granted"))
    return (turn.unionByName(start).repartition(1).sortWithinPartitions("at").select("id", "owner", "value", "granted")
            .mapInArrow(_grants_of_run, "id long, granted boolean"))


def resolve_claims(requests: DataFrame, holders: DataFrame, small_rows: int = SMALL_ROWS,
                   turn_rows: int = TURN_ROWS) -> DataFrame:
    """req_id, granted for requests (req_id, req_ts, owner, value; no nulls) given holders (owner, value; a row an
    owner, no null owner). An owner's held null is no value. Without ``small_rows`` all is decided in rounds."""
    asked = kept(requests.select(F.col("req_id").cast("long").alias("id"), "owner", "value",
                                 order_key(requests, ["req_ts", "req_id"]).alias("at")), "claims")
    held = holders.where("value IS NOT NULL").select("value", "owner").distinct()
    relevant = kept(held.join(asked.select("value").distinct(), "value", "left_semi")
                    .unionByName(held.join(asked.select("owner").distinct(), "owner", "left_semi")).distinct(), "claims")
    several = relevant.groupBy("value").count().where("count > 1").select("value", F.lit(True).alias("shared"))
    start = relevant.select(F.lit(None).cast("long").alias("id"), "owner", "value", _moment(BEFORE).alias("at"),
                            F.lit(True).alias("granted"))
    rows = (asked.withColumn("granted", F.lit(None).cast("boolean")).unionByName(start).join(several, "value", "left")
            .withColumn("shared", F.coalesce("shared", F.lit(False))))
    left, turns, ahead = asked.count(), 1, [lambda _: _at_first_sight(asked, relevant)]
    out = None
    while left:
        if not ahead and not small_rows:
            ahead = [_round]
        elif not ahead:
            ahead = [lambda rows: _in_small_parts(rows, small_rows), _round, *[lambda rows: _in_turn(rows, turn_rows)] * turns]
        way = ahead.pop(0)
        if way is _round and small_rows and left <= turn_rows:
            continue  # a turn is likely to be the last
        now = kept(way(rows), "claims")
        out = now if out is None else out.unionByName(now)
        decided = now.count()
        if way is _round:
            turns = 1 if decided >= turn_rows else 2 * turns
        left -= decided
        if left:
            outcome = now.select("id", F.col("granted").alias("outcome"))
            rows = kept(rows.join(outcome, "id", "left").withColumn("granted", F.coalesce("granted", "outcome"))
                        .drop("outcome").where("granted IS NULL OR granted"), "claims")
            left = rows.where("granted IS NULL").count()
    out = asked.select("id", F.lit(None).cast("boolean").alias("granted")).limit(0) if out is None else out
    return out.select(F.col("id").alias("req_id"), "granted")
