import random

import pytest

from kgspark import fixed
from kgspark.operators import sequential as Q
from tests.test_similarity import plain_jw

LIMIT = {t.name: (t.jw_threshold, t.token_overlap) for t in fixed.ENTITY_TYPES}


def plain_ingest(mentions, registry):
    """One by one: exact, alias, fuzzy over the entities so far, else a new one."""
    known = [(u, k, n, set(a)) for u, n, k, a in registry]
    out, created = {}, []
    for mid, _, name, kind, _ in sorted(mentions, key=lambda m: m[4]):
        norm = name.lower().strip()
        limit, overlap = LIMIT.get(kind, (0.9, True))
        fit = [e for e in known if kind is None or e[1] == kind]
        best = min([(-3.0, u) for u, _, n, _ in fit if n == norm] + [(-2.0, u) for u, _, _, a in fit if norm in a], default=None)
        if best is None and norm:
            near = []
            for u, _, n, _ in fit:
                a, b = norm.split(), n.split()
                shared = len(set(a) & set(b))
                if plain_jw(norm, n) >= limit and (not overlap or len(a) == 1 or len(b) == 1 or (shared >= 2 and shared >= 0.5 * min(len(set(a)), len(set(b))))):
                    near.append((-plain_jw(norm, n), u))
            best = min(near, default=None)
        if best is None:
            uri = f"new:{kind or 'Concept'}:{norm}"
            known.append((uri, kind or "Concept", norm, set()))
            created.append(uri)
            out[mid] = (uri, True)
        else:
            out[mid] = (best[1], False)
    return out, created


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_similar_names(spark, seed, monkeypatch):
    """Typos of typos, names without a type, exact repeats, stored entities and aliases."""
    rnd = random.Random(seed)
    base = ["river keepers guild", "seed library", "soil web", "tool commons", "watershed map"]
    names = list(base)
    for _ in range(70):
        w = list(rnd.choice(names))
        w[rnd.randrange(len(w))] = rnd.choice("abcdefg ")
        names.append(" ".join("".join(w).split()))
    kinds = ["Concept", "Practice", None, "Concept"]
    mentions = [(f"m{i}", f"d{i % 4}", rnd.choice(names), rnd.choice(kinds), (i * 37) % 101) for i in range(100)]
    registry = [("s:1", "soil web", "Concept", ["humus net"]), ("s:2", "tool commmons", "Practice", []), ("s:3", "seed", "Concept", ["library"])]
    mentions += [("a", "d0", "Humus Net", "Concept", 500), ("b", "d0", "library", None, 501), ("c", "d1", "soil web", "Concept", 502)]
    want, created = plain_ingest(mentions, registry)
    df = spark.createDataFrame(mentions, "mention_id string, document_rid string, name string, entity_type string, at long").repartition(3)
    stored = spark.createDataFrame([(u, n, k, n, a) for u, n, k, a in registry], "uri string, entity_text string, entity_type string, normalized_text string, aliases array<string>")
    links = spark.createDataFrame([("d0", "s:1", 4)], "document_rid string, entity_uri string, mention_count long")
    # The plain loop names new entities without a hash; their order by name decides ties alike.
    monkeypatch.setattr(Q.X, "entity_uri", lambda name, kind: Q.F.concat(Q.F.lit("new:"), kind, Q.F.lit(":"), Q.X.normalize_name(name)))
    done, new, after = Q.ingest_in_order(df, stored, links, "at")
    assert {r.mention_id: (r.uri, r.is_new) for r in done.collect()} == want
    assert sorted(r.uri for r in new.collect()) == sorted(created) and len(created) > 5
    counts = {}
    for mid, doc, *_ in mentions:
        counts[(doc, want[mid][0])] = counts.get((doc, want[mid][0]), 0) + 1
    counts[("d0", "s:1")] = counts.get(("d0", "s:1"), 0) + 4
    assert {(r.document_rid, r.entity_uri): r.mention_count for r in after.collect()} == counts


def test_leaders_are_greedy(spark):
    rnd = random.Random(9)
    pairs = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(90)) if a != b}
    want = set()
    for i in range(60):
        if not any((i, j) in pairs for j in want if j < i):
            want.add(i)
    names = spark.createDataFrame([(i,) for i in range(60)], "number long")
    got = Q.leaders(names, spark.createDataFrame(list(pairs), "number long, other long"))
    assert {r.number for r in got.collect()} == want
