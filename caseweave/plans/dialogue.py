"""Batch question answering: intent, entities, context per session, route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.functions import text as tx
from caseweave.operators.scale import carry_forward

CASE_COLUMNS = ["intent", "person", "case_id", "tier", "place"]


def parse_messages(messages: DataFrame, text: str, gazetteer: DataFrame, name: str) -> DataFrame:
    """Intent, own entities and whether the text points back to an earlier person or place."""
    parsed = messages.withColumns({
        "intent": tx.classify(F.col(text)),
        "person": tx.first_match(F.col(text), tx.PERSON_ID_PATTERN),
        "case_id": tx.first_match(F.col(text), tx.CASE_ID_PATTERN),
        "tier": tx.first_match(F.col(text), tx.TIER_PATTERN),
    })
    located = tx.find_longest_name(parsed, text, gazetteer, name, "place")
    return located.withColumns({
        "person_back": F.col("person").isNull() & F.col(text).rlike(tx.PERSON_PRONOUN_PATTERN),
        "place_back": F.col("place").isNull() & F.col(text).rlike(tx.PLACE_PRONOUN_PATTERN),
    })


def answer_messages(parsed: DataFrame, session: str, turn: str, people: DataFrame, person: str) -> DataFrame:
    """Adds the resolved person and place and the route of every message.

    Context is only updated by a message that succeeds: its intent is handled, what
    the intent needs is known, and a needed person exists. Whether a back-reference
    succeeds depends on whether there was any context yet, that is on the first
    successful person and place of the session; these two turns are settled first,
    and then the context itself is a carried-forward value.
    """
    known = people.select(F.col(person).alias("person"), F.lit(True).alias("known"))
    rows = parsed.join(known, "person", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    handled = ~F.col("intent").isin("help", "unknown")
    wants_person, wants_place = F.col("intent").isin(tx.PERSON_INTENTS), F.col("intent").isin(tx.PLACE_INTENTS)
    rows = rows.withColumns({
        "sure": handled & (~wants_person | F.col("known")) & (~wants_place | F.col("place").isNotNull()),
        "if_person": handled & wants_person & F.col("person_back"),
        "if_place": handled & wants_place & F.col("place_back"),
    })
    own_person, own_place = F.col("person").isNotNull(), F.col("place").isNotNull()

    def first_turn(cond: Column) -> Column:
        return F.min(F.when(cond, F.col(turn)))

    starts = rows.groupBy(session).agg(
        first_turn(F.col("sure") & own_person).alias("p0"), first_turn(F.col("sure") & own_place).alias("l0")
    )
    never = F.lit(2**62)
    chained = rows.join(starts, session).groupBy(session).agg(
        F.min(F.coalesce("p0", never)).alias("p0"), F.min(F.coalesce("l0", never)).alias("l0"),
        first_turn(F.col("if_person") & own_place & (F.col(turn) > F.col("p0"))).alias("l1"),
        first_turn(F.col("if_place") & own_person & (F.col(turn) > F.col("l0"))).alias("p1"),
    ).select(session, F.least("p0", F.coalesce("p1", never)).alias("person_from"), F.least("l0", F.coalesce("l1", never)).alias("place_from"))
    settled = rows.join(chained, session).withColumn(
        "succeeds",
        F.col("sure") | (F.col("if_person") & (F.col(turn) > F.col("person_from"))) | (F.col("if_place") & (F.col(turn) > F.col("place_from"))),
    ).withColumns({
        "ctx_person": F.when(F.col("succeeds"), F.col("person")), "ctx_place": F.when(F.col("succeeds"), F.col("place")),
    })
    carried = carry_forward(settled, [session], turn, ["ctx_person", "ctx_place"])
    resolved = carried.withColumns({
        "resolved_person": F.coalesce("person", F.when(F.col("person_back"), F.col("prev_ctx_person"))),
        "resolved_place": F.coalesce("place", F.when(F.col("place_back"), F.col("prev_ctx_place"))),
    })
    route = tx.clarification(F.col("intent"), F.col("resolved_person"), F.col("resolved_place"))
    missing = wants_person & own_person & ~F.col("known")
    return resolved.withColumn("route", F.when((route == F.col("intent")) & missing, F.lit("not_found")).otherwise(route))
