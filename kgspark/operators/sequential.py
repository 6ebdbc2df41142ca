"""Ingestion as if mentions came one by one: a later mention sees the entities that earlier ones created.

A mention that matches nothing becomes an entity (a leader); later mentions of
the same or of a similar name join it. Who leads follows from the order alone,
so it is decided in rounds over the match graph, all open names at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.operators import resolve as R
from kgspark.session import cut_lineage, erase

#: Strength of a match in the order of the tiers; a fuzzy match is as strong as its score.
EXACT, ALIAS = 3.0, 2.0


def _keys(mentions: DataFrame, order: str) -> DataFrame:
    """One row per (norm, alias, entity_type): number (the order of its first mention), name, kind and uri if it becomes an entity."""
    keyed = mentions.select(
        X.normalize_name(F.col("name")).alias("norm"), X.normalize_alias(F.col("name")).alias("alias"), "entity_type", "name", F.col(order).alias("number"))
    kind = F.coalesce("entity_type", F.lit("Concept"))
    first = keyed.groupBy("norm", "alias", "entity_type").agg(F.min("number").alias("number"), F.min_by("name", "number").alias("name"))
    return first.withColumn("kind", kind).withColumn("made", X.entity_uri(F.col("name"), kind))


def _stored_matches(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """(number, strength, uri) of the best match among the stored entities."""
    same = [F.col("norm") == F.col("f_norm"), F.col("entity_type").eqNullSafe(F.col("f_type"))]
    surface = R.by_surface(keys.select("norm", "alias", "entity_type"), registry).toDF("f_norm", "f_alias", "f_type", "tier", "uri")
    found = cut_lineage(keys.join(surface, [*same, F.col("alias") == F.col("f_alias")]).select(
        "number", F.when(F.col("tier") == 1, EXACT).otherwise(ALIAS).alias("strength"), "uri"), "stored-surface")
    rest = cut_lineage(keys.join(found.select("number"), "number", "left_anti"), "stored-open")
    fuzzy = R.by_fuzzy(rest.select("norm", "alias", "entity_type"), registry).select(F.col("norm").alias("f_norm"), F.col("entity_type").alias("f_type"), "uri", "score")
    return found.unionByName(rest.join(fuzzy, same).select("number", F.col("score").alias("strength"), "uri"))


#: Open names that are compared with each other at first, and how many times more of those that are left in each later step.
FIRST, GROWTH = 1024, 4


def _matches(keys: DataFrame, asking: DataFrame, names: DataFrame) -> DataFrame:
    """(number, other, strength): which of ``names`` each key would match if they were entities; ``asking`` have a fuzzy tier."""
    known = names.select(F.col("number").alias("other"), F.col("norm").alias("o_norm"), F.col("kind").alias("o_kind"))
    fits = F.col("entity_type").isNull() | (F.col("entity_type") == F.col("o_kind"))
    equal = keys.join(known, (F.col("norm") == F.col("o_norm")) & fits).select("number", "other", F.lit(EXACT).alias("strength"))
    stored = names.select(F.col("made").alias("uri"), F.col("kind").alias("entity_type"), F.col("norm").alias("normalized_text"))
    pairs = R.fuzzy_pairs(asking.select("norm", "alias", "entity_type"), stored).select(
        F.col("norm").alias("f_norm"), F.col("entity_type").alias("f_type"), F.col("candidate").alias("o_norm"), "score").filter("f_norm <> o_norm")
    near = asking.join(pairs, (F.col("norm") == F.col("f_norm")) & F.col("entity_type").eqNullSafe(F.col("f_type"))).drop("f_norm", "f_type")
    return equal.unionByName(near.join(known, "o_norm").filter(fits).select("number", "other", F.col("score").alias("strength")))


def _decided(keys: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names of the batch that become entities, and (number, other, strength) of all keys that match one of them.

    Names are taken in order, some at a time: these are compared with each
    other, which settles them, and all others with their leaders alone. Names
    that match a leader are settled too, so no name meets one that does not lead
    but those taken with it.
    """
    # Only names without a stored match can become entities; those found by their form have no fuzzy tier.
    left = cut_lineage(keys.join(stored, "number", "left_anti").filter("number IS NOT NULL"), "candidates")
    asking = cut_lineage(keys.join(stored.filter(F.col("strength") >= ALIAS).select("number"), "number", "left_anti"), "asking")
    lead, matches, size, rest = left.limit(0), None, FIRST, left.count()
    while rest:
        share = size / rest
        taken, later = left, None
        if share < 1:
            bound = F.lit(left.approxQuantile("number", [share], share / 4)[0])
            taken, later = cut_lineage(left.filter(F.col("number") <= bound), "taken"), left.filter(F.col("number") > bound)
        among = cut_lineage(_matches(taken, taken, taken), "among")
        new = cut_lineage(taken.join(leaders(taken, among), "number", "left_semi"), "lead")
        found = cut_lineage(_matches(keys, asking, new), "matches")
        erase(among)
        lead, matches = lead.unionByName(new), found if matches is None else matches.unionByName(found)
        if later is None:
            break
        before, left = left, cut_lineage(later.join(found.select("number"), "number", "left_anti"), "candidates")
        erase(before, taken)
        size, rest = size * GROWTH, left.count()
    if matches is None:
        matches = _matches(keys.limit(0), asking.limit(0), lead)
    return lead, matches


def leaders(names: DataFrame, matches: DataFrame) -> DataFrame:
    """Numbers that lead: those of ``names`` without a match (number, other) to an earlier leader.

    A name is settled once an earlier match of it leads, or none of them can
    any more; the earliest open name always is, and in a round all that can be.
    """
    earlier = cut_lineage(matches.filter("other < number").select("number", "other").distinct(), "earlier")
    state = cut_lineage(names.select("number").join(earlier.select("number").distinct().withColumn("open", F.lit(True)), "number", "left").select(
        "number", F.when(F.col("open"), F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("leads")), "leaders")
    while not state.filter("leads IS NULL").isEmpty():
        asked = earlier.join(state.filter("leads IS NULL").select("number"), "number", "left_semi")
        # A match that is no candidate (it has a stored match) is missing in the state: it never leads.
        seen = asked.join(state.withColumnRenamed("number", "other"), "other", "left").select("number", F.when(F.col("leads").isNull(), F.lit("open")).when(F.col("leads"), "leads").otherwise("no").alias("s"))
        seen = seen.groupBy("number").agg(F.bool_or(F.col("s") == "leads").alias("joins"), F.bool_or(F.col("s") == "open").alias("waits"))
        now = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("joins"), False).when(~F.col("waits"), True)
        before, state = state, cut_lineage(state.join(seen, "number", "left").select("number", now.alias("leads")), "leaders")
        erase(before)
    return state.filter("leads").select("number")


def ingest_in_order(mentions: DataFrame, registry: DataFrame, links: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved mentions, new entities, and document links after a batch taken in ``order`` (a unique column).

    ``mentions`` is (mention_id, document_rid, name, entity_type, order). Tiers
    are exact, alias (stored entities only), fuzzy, then a new entity; among
    equally strong matches the smallest uri wins, as in ``resolve``.
    """
    keys = cut_lineage(_keys(mentions, order), "names")
    stored = cut_lineage(_stored_matches(keys, registry), "stored")
    lead, matches = _decided(keys, stored)
    made = lead.select(F.col("number").alias("other"), F.col("made").alias("uri"))
    # From when on a match can be seen: stored ones from the start, an entity of the batch after the mention that made it.
    seen = stored.select("number", F.lit(None).cast("bigint").alias("since"), "strength", "uri").unionByName(
        matches.join(made, "other").select("number", F.col("other").alias("since"), "strength", "uri"))
    own = X.normalize_name(F.col("name")), X.normalize_alias(F.col("name"))
    placed = mentions.select("mention_id", F.col(order).alias("at"), "name", "entity_type", own[0].alias("norm"), own[1].alias("alias"))
    key = keys.select("number", F.col("norm").alias("k_norm"), F.col("alias").alias("k_alias"), F.col("entity_type").alias("k_type"), "made")
    placed = placed.join(key, (F.col("norm") == F.col("k_norm")) & (F.col("alias") == F.col("k_alias")) & F.col("entity_type").eqNullSafe(F.col("k_type")))
    placed = cut_lineage(placed.select("mention_id", "at", "name", "entity_type", "number", "made"), "placed")
    done = placed.join(_steps(seen), "number", "left").filter(
        (F.col("since").isNull() | (F.col("since") < F.col("at"))) & (F.col("until").isNull() | (F.col("at") <= F.col("until"))))
    done = placed.join(done.select("mention_id", "strength", "uri"), "mention_id", "left")
    is_new = F.col("uri").isNull()
    tier = F.when(is_new, "created").when(F.col("strength") == EXACT, "exact").when(F.col("strength") == ALIAS, "alias").otherwise("fuzzy")
    confidence = F.when(is_new, 0.9).otherwise(F.least("strength", F.lit(1.0)))
    done = done.select("mention_id", "name", "entity_type", F.coalesce("uri", "made").alias("uri"), F.round(confidence, 6).alias("confidence"), tier.alias("tier"), is_new.alias("is_new"))
    done = cut_lineage(done, "ingested")
    new = lead.select(F.col("made").alias("uri"), F.col("name").alias("entity_text"), F.col("kind").alias("entity_type"), F.col("norm").alias("normalized_text"))
    counted = done.select("mention_id", "uri").join(mentions.select("mention_id", "document_rid"), "mention_id").groupBy("document_rid", F.col("uri").alias("entity_uri")).agg(F.count("*").alias("mention_count"))
    after = links.select("document_rid", "entity_uri", "mention_count").unionByName(counted).groupBy("document_rid", "entity_uri").agg(F.sum("mention_count").alias("mention_count"))
    return done, new, after


def _steps(seen: DataFrame) -> DataFrame:
    """(number, since, until, strength, uri): the best match so far of each name, and while it is that.

    Only matches better than all before them are kept, so a name with very many
    mentions meets a few disjoint intervals.
    """
    ranked = F.struct((-F.col("strength")).alias("neg"), "uri")
    by_time = Window.partitionBy("number").orderBy(F.col("since").asc_nulls_first())
    best = seen.groupBy("number", "since").agg(F.min(ranked).alias("b"))
    running = best.withColumn("before", F.min("b").over(by_time.rowsBetween(Window.unboundedPreceding, -1)))
    better = running.filter(F.col("before").isNull() | (F.col("b") < F.col("before"))).select("number", "since", "b")
    stepped = better.withColumn("until", F.lead("since").over(by_time))
    return stepped.select("number", "since", "until", (-F.col("b.neg")).alias("strength"), F.col("b.uri").alias("uri"))
