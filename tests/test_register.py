from kgspark.operators import register as G


def test_registration(spark):
    registry = spark.createDataFrame(
        [("u:ann", "Ann Marsh", "Person", "ann marsh", ["annie"], None, "orn:kept"), ("u:web", "Soil Web", "Concept", "soil web", None, "vault:old", None), ("u:other", "Other", "Person", "other", [], None, None)],
        "uri string, entity_text string, entity_type string, normalized_text string, aliases array<string>, vault_rid string, koi_rid string")
    batch = spark.createDataFrame([
        ("vault:a", "People/a.md", "annie", "Person", "h1", ["[[People/Annie M]]", None, "annie"], 1),
        ("vault:b", "Concepts/b.md", "Soil Webb", "Concept", "h2", None, 2),
        ("vault:c", "Practices/c.md", "Kelp planting circle", "Practice", "h3", ["KPC"], 3),
        ("vault:c2", "Practices/c2.md", "Kelp planting circles", "Practice", "h4", ["kelp"], 4),
        ("vault:a", "People/new.md", "Ann Marsh", "Person", "h5", [], 5)], "vault_rid string, vault_path string, name string, entity_type string, content_hash string, aliases array<string>, at int")
    mappings = spark.createDataFrame([("vault:z", "z.md", "u:other", "Person", "Other", "h", "linked"), ("vault:b", "old.md", "u:other", "Concept", "x", "h", "conflict")],
                                     "vault_rid string, vault_path string, canonical_uri string, entity_type string, name string, content_hash string, sync_status string")
    pending = spark.createDataFrame([(1, "u:ann", "leads", None, "Kelp Planting Circle", "object", "Practice", "leads"), (2, "u:ann", "knows", None, "Nobody", "object", None, "knows")],
                                    "pending_id long, subject_uri string, predicate string, object_uri string, raw_unknown_label string, unknown_side string, target_type_hint string, source_field string")
    out = G.register(batch, registry, mappings, pending, "at")
    reg = {r.uri: r for r in out.registry.collect()}
    kelp = next(u for u in reg if "kelp" in u)
    assert set(reg) == {"u:ann", "u:web", "u:other", kelp}
    assert (reg["u:ann"].aliases, reg["u:ann"].vault_rid, reg["u:ann"].koi_rid) == (["annie", "annie m"], "vault:a", "orn:kept")
    assert (reg["u:web"].aliases, reg["u:web"].vault_rid) == (None, "vault:old") and reg["u:web"].koi_rid.startswith("orn:koi-net.concept:soil-web+")
    assert (reg[kelp].aliases, reg[kelp].vault_rid) == (["kelp", "kpc"], "vault:c") and reg["u:other"].koi_rid is None
    assert {r.vault_rid: (r.canonical_uri, r.vault_path, r.sync_status) for r in out.mappings.collect()} == {
        "vault:a": ("u:ann", "People/new.md", "linked"), "vault:b": ("u:web", "Concepts/b.md", "linked"), "vault:c": (kelp, "Practices/c.md", "linked"),
        "vault:c2": (kelp, "Practices/c2.md", "linked"), "vault:z": ("u:other", "z.md", "linked")}
    assert [tuple(r)[:4] for r in out.promoted.collect()] == [(1, "u:ann", "leads", kelp)]
    assert {r["at"]: (r.rid, r.event_type) for r in out.events.collect()} == {
        1: ("orn:kept", "UPDATE"), 2: (reg["u:web"].koi_rid, "UPDATE"), 3: (reg[kelp].koi_rid, "NEW"), 4: (reg[kelp].koi_rid, "UPDATE"), 5: ("orn:kept", "UPDATE")}
