"""Where load comes from: nothing, a jam on one segment, seeded noise, or a file of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.congestion import inject, loads, perturb
from ..operators.network import Network
from .messages import read_messages

JAM_VPH = 50_000.0


def load_from(network: Network, source: str = "", jam: str | None = None, jam_vph: float = JAM_VPH, seed: int = 1, steps: int = 1) -> DataFrame:
    """(edge_id, load_vph) of every edge.

    ``source``: "" for no load, "sim" for a perturbed jam, else a path of messages.
    A jam can't be put on top of a file, and has to name a segment of the network.
    """
    edges = network.edges.select("edge_id", "segment_id")
    zero = edges.select("edge_id", F.lit(0.0).alias("load_vph"))
    if source not in ("", "sim"):
        if jam:
            raise ValueError("a file of messages already carries the load; a jam can't be added to it")
        return network.with_load(loads(read_messages(edges.sparkSession, source), edges)).select("edge_id", "load_vph")
    if not jam:
        return zero
    hit = edges.where(F.col("segment_id") == jam).select("edge_id", F.lit(float(jam_vph)).alias("load_vph"))
    if hit.isEmpty():
        raise ValueError(f"no segment {jam!r} in the network")
    now = inject(zero, hit)
    return perturb(now, seed, steps) if source == "sim" else now
