"""Queries of the sequential operators and of the stream forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import selection
from trackloom.operators.frames import documents
from trackloom.plans.events import mergeable_pairs, phenomenon_profile, video_verdict
from trackloom.session import cut
from trackloom.tables import load

# fixed values: wanted videos and weight of each slot
SLOTS = {
    "occlusion_reappear": (200, 1.0), "partial_occlusion": (200, 1.0), "exit_reenter": (150, 1.0), "appear_disappear": (120, 0.8), "state_change": (100, 0.6), "interaction": (250, 1.0), "multi_phenomenon": (150, 1.2),
    "has_reappear_identity_candidate": (300, 1.5), "has_conditional_state_pair": (400, 1.3), "has_countable_event": (300, 1.3), "has_cross_event_chain": (300, 1.2), "has_high_confidence_objects": (500, 1.0),
}


def selected_videos(spark: SparkSession, d: str) -> DataFrame:
    """Greedy cover of phenomenon slots, then quality."""
    doc = documents(load(spark, d, "tracks")).select("video_id", "source", F.col("metadata.duration").alias("duration"), F.size("objects").alias("n_objects"))
    profile = phenomenon_profile(spark, d).join(video_verdict(spark, d).where("passed").select("video_id", "score"), "video_id").join(doc, "video_id")
    return selection.select_videos(cut(profile), SLOTS, 1000)


def merged_fragments(spark: SparkSession, d: str) -> DataFrame:
    return selection.merge_fragments(mergeable_pairs(spark, d))


def probe_orders(spark: SparkSession, d: str) -> DataFrame:
    """Probe order of 16 frames, spread over the frames of every video."""
    order = selection.probe_order(16)
    n = load(spark, d, "tracks").select("video_id", F.size("timestamps").alias("n")).where("n > 0").groupBy("video_id").agg(F.max("n").alias("n"))
    probe = F.posexplode(F.array(*map(F.lit, order))).alias("place", "slot")
    return n.select("video_id", "n", probe).select("video_id", "place", (F.col("slot") * F.col("n") / 16).cast("int").alias("frame"))


QUERIES = {"selected_videos": selected_videos, "merged_fragments": merged_fragments, "probe_orders": probe_orders}
SQL: dict[str, str] = {
    "probe_orders": "SELECT video_id, place::INT AS place, floor(slot * n / 16.0)::INT AS frame FROM (SELECT video_id, max(len(timestamps)) AS n FROM tracks GROUP BY video_id HAVING max(len(timestamps)) > 0), "
    + "(SELECT unnest([7, 3, 11, 1, 5, 9, 13, 0, 2, 4, 6, 8, 10, 12, 14, 15]) AS slot, unnest(range(0, 16)) AS place)",
}
