"""The stream fold of cross-references gets the columns it uses."""

from kgspark.sources import tables as T
from kgspark.streaming import state as K

SF = "/root/testdata/sf0.001"


def test_fold_gets_what_it_uses(spark):
    events = T.network_events(spark, SF).withColumn("peer", T.F.col("source_node"))
    rows = K.fold_input(events, T.entity_registry(spark, SF, ["Person"]))
    assert set(rows.columns) == {"rid", "source_node", "queued_at", "id", "event_type", "local_uri", "relationship", "confidence"}
    assert rows.count() == events.count()
