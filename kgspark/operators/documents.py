"""Chunking and search over documents, sessions and vectors."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import similarity as S
from kgspark.functions import text as X
from kgspark.session import spread


def _pieces(df: DataFrame, keys: list[str], tokens: Column, bounds: Column, stripped: Column) -> DataFrame:
    """One row per (start, end) of each document; a single chunk keeps its original spacing."""
    # Bounds and tokens are computed once per document; each output row holds its own slice only.
    parts = F.transform(
        bounds,
        lambda b: F.struct(
            b["s"].alias("start_token"), b["e"].alias("end_token"),
            F.when(F.size(bounds) == 1, F.when(F.size(tokens) <= b["e"], stripped).otherwise(F.array_join(F.slice(tokens, b["s"] + 1, b["e"] - b["s"]), " ")))
            .otherwise(F.array_join(F.slice(tokens, b["s"] + 1, b["e"] - b["s"]), " ")).alias("text"),
        ),
    )
    return df.select(*keys, F.size(bounds).alias("total_chunks"), F.posexplode(parts).alias("chunk_index", "c")).select(
        *keys, "chunk_index", "total_chunks", "c.start_token", "c.end_token", F.col("c.text").alias("text")
    )


def fixed_chunks(df: DataFrame, keys: list[str], size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP,
                 minimum: int = 0) -> DataFrame:
    """Overlapping windows of whitespace tokens; a document up to ``size`` stays whole.

    The last window ends the document, so the walk always ends and no token is
    lost. With ``minimum``, shorter windows are dropped unless they are the first.
    """
    step = size - overlap
    # The blank test reads the text, so the tokens are not computed a second time for the filter.
    toks = spread(df).filter(X.strip(F.col("text")) != "").withColumn("toks", X.words(F.col("text")))
    n = F.size("toks")
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    bounds = F.filter(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct((i * step).alias("s"), F.least(i * step + size, n).alias("e")),
        ),
        lambda b: (b["s"] == 0) | (b["e"] - b["s"] >= minimum),
    )
    ready = toks.withColumn("bounds", bounds).withColumn("stripped", X.strip(F.col("text")))
    return _pieces(ready, keys, F.col("toks"), F.col("bounds"), F.col("stripped"))


def sentence_chunks(df: DataFrame, keys: list[str], size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP,
                    minimum: int = fixed.CHUNK_MIN, keep_tail: bool = True) -> DataFrame:
    """Windows that end at a sentence end within their last fifth where there is one.

    The next start depends on the last cut, so the cuts of a document are an
    ``aggregate`` over at most as many steps as it can have windows; all of it
    stays in the JVM. A remainder shorter than
    ``minimum`` becomes a chunk of its own, or is dropped without ``keep_tail``.
    """
    # The blank test reads the text, so the tokens are not computed a second time for the filter.
    toks = spread(df).filter(X.strip(F.col("text")) != "").withColumn("toks", X.words(F.col("text")))
    n = F.size("toks")
    # Positions just after sentence-final tokens, the only places a cut may move to.
    stops = F.filter(F.transform("toks", lambda t, i: F.when(t.endswith(".") | t.endswith("!") | t.endswith("?"), i + 1)), lambda p: p.isNotNull())
    ready = toks.withColumn("stops", stops).withColumn("stripped", X.strip(F.col("text")))
    smallest = size - size // 5 - overlap
    # A full window moves the start on by at least `smallest` tokens, and once a window
    # reaches the end of the text every later one is below the minimum, so this many steps do.
    bounds = F.expr(f"""
        CASE WHEN size(toks) <= {size} THEN array(struct(0 AS s, size(toks) AS e)) ELSE
        aggregate(
          sequence(0, cast(ceil(size(toks) / {max(smallest, 1)}) AS int) + 1),
          struct(0 AS s, cast(array() AS array<struct<s:int,e:int>>) AS cuts),
          (acc, i) -> CASE
            WHEN acc.s >= size(toks) OR (size(toks) - acc.s < {minimum} AND acc.s > 0) THEN acc
            ELSE (
              transform(array(least(acc.s + {size}, size(toks))), t ->
                transform(array(coalesce(
                  array_max(filter(stops, p -> p <= t AND p > greatest(acc.s, t - {size // 5}))), t)), e ->
                  struct(greatest(e - {overlap}, acc.s + 1) AS s,
                         CASE WHEN e - acc.s >= {minimum} OR acc.s = 0
                              THEN array_append(acc.cuts, struct(acc.s AS s, e AS e)) ELSE acc.cuts END AS cuts))[0])[0]
            ) END,
          acc -> acc.cuts) END""")
    if keep_tail:
        ready = ready.withColumn("cuts", bounds)
        tail = F.element_at("cuts", -1)["e"]
        bounds = F.when(tail < n, F.array_append("cuts", F.struct(tail.alias("s"), n.alias("e")))).otherwise(F.col("cuts"))
    return _pieces(ready.withColumn("bounds", bounds), keys, F.col("toks"), F.col("bounds"), F.col("stripped"))


def embed_text(title: Column, text: Column, max_words: Optional[int] = None, max_chars: Optional[int] = None) -> Column:
    """Title and words of a document, which is what is embedded for it; for a model with a limit the first ``max_words`` or ``max_chars``."""
    words = X.words(text)
    whole = F.concat_ws("\n", title, F.array_join(F.slice(words, 1, max_words) if max_words else words, " "))
    return F.substring(whole, 1, max_chars) if max_chars else whole


def text_search(df: DataFrame, pattern: str, limit: int, newest: Column, source: Optional[str] = None,
                preview: int = 500) -> DataFrame:
    """Case-insensitive containment search, newest first, ties by rid."""
    hit = df.filter(F.col("text").ilike(f"%{pattern}%"))
    hit = hit.filter(F.col("source_sensor") == source) if source else hit
    return hit.orderBy(newest, "rid").limit(limit).select(
        "rid", "source_sensor", F.substring("text", 1, preview).alias("content_preview"), X.hit_slug(F.col("rid")).alias("site_path")
    )


def nearest(df: DataFrame, query, k: int, keep: list[str], at_least: Optional[float] = None) -> DataFrame:
    """k rows nearest to one query vector by cosine; ``at_least`` filters after the limit."""
    same_length = F.size("vec") == len(query)
    ranked = (
        df.filter(F.col("vec").isNotNull() & same_length)
        .withColumn("similarity", F.round(S.cosine(F.col("vec"), S.vector_literal(query)), 6))
        .orderBy(F.desc_nulls_last("similarity"), *keep).limit(k)
    )
    ranked = ranked.filter(F.col("similarity") >= at_least) if at_least is not None else ranked
    return ranked.select(*keep, "similarity")


def trigram_search(registry: DataFrame, query: str, k: int, above: float = 0.2) -> DataFrame:
    """Entities whose name resembles the query text, best first."""
    grams = S.trigrams(F.lit(query))
    scored = registry.withColumn("similarity", F.round(S.jaccard(S.trigrams(F.col("entity_text")), grams), 6))
    return scored.filter(F.col("similarity") > above).orderBy(F.desc("similarity"), "uri").limit(k)


def entity_hits(hits: DataFrame, degrees: DataFrame, first: int = 5) -> DataFrame:
    """Search hits with the degree of the best ``first`` of them (null for the rest)."""
    best = hits.orderBy(F.desc("similarity"), "uri").limit(first).select("uri")
    counted = degrees.join(best, "uri", "left_semi")
    return hits.join(counted, "uri", "left")


def session_search(turns: DataFrame, log: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Session chunks containing the text, newest session first (unlogged ones lead)."""
    hit = turns.filter(F.col("text").ilike(f"%{pattern}%"))
    return (
        hit.join(log, "session_id", "left")
        .orderBy(F.desc_nulls_first("started"), "session_id", "chunk_index").limit(limit)
        .select("session_id", "chunk_index", "role", "started", F.substring("text", 1, 200).alias("preview"))
    )


def related_documents(mentions: DataFrame, links: DataFrame, topics: Optional[DataFrame] = None) -> DataFrame:
    """Documents related to given entities, each tagged with the strategies that found it.

    ``mentions`` is (strategy, entity_uri); ``topics`` is (strategy, document_rid)
    of documents found by text. The union replaces separate lookups.
    """
    found = links.join(mentions, "entity_uri").select("strategy", "document_rid")
    found = found.unionByName(topics) if topics is not None else found
    return found.groupBy("document_rid").agg(F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))


def source_sensor(source: Optional[str]) -> Optional[str]:
    """The sensor a short source name stands for; other names stand for themselves."""
    return fixed.SOURCE_SENSORS.get(source, source)


def knowledge_search(memories: DataFrame, chunks: DataFrame, query, k: int, source: Optional[str] = None, mail: Optional[DataFrame] = None, preview: int = 500) -> DataFrame:
    """The k nearest documents and the k nearest chunks of one query vector, ``hit`` says which.

    ``memories`` is (rid, title, text, source_sensor, vec), ``chunks``
    (chunk_rid, document_rid, text, vec). Only chunks of known documents count.
    ``mail`` (rid, subject, from_name, from_address, date_sent) is looked up
    for hits that came by mail.
    """
    held = memories.filter(F.col("source_sensor") == source_sensor(source)) if source else memories
    docs = nearest(held, query, k, ["rid"]).join(held.select("rid", "title", "text", "source_sensor"), "rid").select(
        F.lit("document").alias("hit"), "rid", F.col("rid").alias("document_rid"), "title", F.substring("text", 1, preview).alias("preview"), "similarity", "source_sensor")
    owner = held.select(F.col("rid").alias("document_rid"), "title", "source_sensor")
    known = chunks.join(owner.select("document_rid"), "document_rid", "left_semi")
    found = nearest(known, query, k, ["chunk_rid", "document_rid"])
    parts = found.join(chunks.select("chunk_rid", "text"), "chunk_rid").join(owner, "document_rid").select(
        F.lit("chunk").alias("hit"), F.col("chunk_rid").alias("rid"), "document_rid", "title", F.substring("text", 1, preview).alias("preview"), "similarity", "source_sensor")
    hits = docs.unionByName(parts)
    if mail is None:
        return hits
    by_mail = mail.select(F.col("rid").alias("document_rid"), F.lit(fixed.SOURCE_SENSORS["email"]).alias("source_sensor"), "subject", "from_name", "from_address", "date_sent")
    return hits.join(by_mail, ["document_rid", "source_sensor"], "left")
