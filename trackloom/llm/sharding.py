"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots (thousands); the bytes of every slot are summed in one pass, and a small
versioned map, a stored table, says which shard owns a slot. To rebalance, or to add a shard, the newest version is read,
edited and stored as the next one: a record never changes its slot. Everything that reaches the driver has one row per slot,
whatever the number of records.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.common import stored

SLOTS = 4096
MAP_SCHEMA = "version int, shards int, virtual_slot int, shard int, bytes long, rows long"


def with_slot(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot): size is UTF-8 bytes + 1 (null text: 1). A record's slot depends on its key and text alone, so one key with many texts is spread, as is one text under many keys."""
    body, own = F.col(f"`{text}`"), F.col(f"`{key}`")
    raw = F.coalesce(body, F.lit("")).cast("binary")
    slot = F.pmod(F.xxhash64(own.isNull(), own.cast("string"), body.isNull(), raw), F.lit(slots)).cast("int")
    return docs.select(own.alias(key), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), slot.alias("virtual_slot"))


def slot_loads(sized: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows) of the slots in use: one aggregation, at most one row per slot to the driver."""
    sums = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in sums.collect()}


@dataclass
class SlotMap:
    """Slot -> shard; ``loads`` are the slots' bytes and rows at the time of the last edit."""

    shard_of: dict[int, int]
    loads: dict[int, tuple[int, int]]
    shards: int
    version: int = 1
    moved: list[int] = field(default_factory=list)
    imbalance: float | None = None

    def __post_init__(self) -> None:
        if sorted(self.shard_of) != list(range(len(self.shard_of))):
            raise ValueError("a slot has no shard")
        if any(not 0 <= k < self.shards for k in self.shard_of.values()):
            raise ValueError("a slot has a shard that isn't there")

    @property
    def slots(self) -> int:
        return len(self.shard_of)

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """The map before anything is known of the records: slots dealt in turn."""
        return cls({s: s % shards for s in range(slots)}, {s: (0, 0) for s in range(slots)}, shards)

    @classmethod
    def build(cls, loads: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
        """The slots, largest first, each to the shard with the fewest bytes yet; ties to the smaller number."""
        loads = {s: loads.get(s, (0, 0)) for s in range(slots)}
        heap, shard_of = [(0, 0, k) for k in range(shards)], {}
        for s in sorted(loads, key=lambda s: (-loads[s][0], s)):
            load, rows, k = heapq.heappop(heap)
            shard_of[s] = k
            heapq.heappush(heap, (load + loads[s][0], rows + 1, k))
        return cls(shard_of, loads, shards)

    def bytes_of(self) -> list[int]:
        out = [0] * self.shards
        for s, k in self.shard_of.items():
            out[k] += self.loads[s][0]
        return out

    def rebalanced(self, loads: dict[int, tuple[int, int]] | None = None, shards: int | None = None, tolerance: float = 0.001) -> SlotMap:
        """The next version, for new loads or more shards: slots move from the fullest to the emptiest shard while that narrows the gap, and only as far as the tolerance asks. ``imbalance`` is what is left between the fullest and the emptiest shard, as a share of the mean: more than the tolerance where slots are too large to be moved, or too many. Where shards are added, slots move into those alone."""
        loads = self.loads if loads is None else {s: loads.get(s, (0, 0)) for s in self.shard_of}
        new = SlotMap(dict(self.shard_of), loads, max(shards or 0, self.shards), self.version + 1)
        owned: dict[int, list[int]] = {k: [] for k in range(new.shards)}
        for s, k in sorted(new.shard_of.items()):
            owned[k].append(s)
        total = new.bytes_of()
        target = sum(total) / new.shards
        takers = range(self.shards, new.shards) or range(new.shards)
        for _ in range(2 * new.slots):
            high, low = max(range(new.shards), key=lambda k: (total[k], -k)), min(takers, key=lambda k: (total[k], k))
            gap = total[high] - total[low]
            if gap <= tolerance * target:
                break
            fit = [s for s in owned[high] if 0 < loads[s][0] < gap]
            if not fit:
                break
            s = min(fit, key=lambda s: (abs(loads[s][0] - gap / 2), s))
            owned[high].remove(s)
            owned[low].append(s)
            new.shard_of[s] = low
            total[high] -= loads[s][0]
            total[low] += loads[s][0]
        new.imbalance = (max(total) - min(total)) / target if target else 0.0
        new.moved = [s for s, k in sorted(new.shard_of.items()) if k != self.shard_of[s]]
        return new

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, k, *self.loads[s]) for s, k in sorted(self.shard_of.items())], MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """One folder per version, which is never written twice; older versions stay readable."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version, the newest if none is given. The folders' names say which there are, so one version alone is read."""
        rows = spark.read.schema(f"{MAP_SCHEMA}, v int").parquet(path)
        version = version or rows.agg(F.max("v")).first()[0]
        own = rows.where(F.col("v") == version).collect()
        if not own:
            raise ValueError(f"the map has no version {version}")
        return cls({r["virtual_slot"]: r["shard"] for r in own}, {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in own}, own[0]["shards"], version)


def assign(docs: DataFrame, slot_map: SlotMap | None = None, path: str | None = None, shards: int = 16, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """One row per record: key, size, text_crc32, virtual_slot, shard, slot (its place in the shard: 0, 1, ...) and map_version, with the map.

    With ``slot_map`` the records go where it says, and the number of slots is the map's. With ``path`` the newest map stored
    there is edited for the records' bytes, stored as the next version, read again and used; where there is none yet, that
    of ``shards`` shards and ``slots`` slots dealt in turn is stored first. Without either a map is built for the records.

    Empty tables give no rows. Null keys and texts and repeated rows are records as any other. Records that are equal in key
    and text share a virtual slot, which is the unit that is moved: no map can split them. A place is the slot's first place in
    its shard, which the slots' row counts give, plus the rank within the slot: windows span a slot, never a shard. Texts are
    never shuffled. The sized rows are stored once, so both passes see the same. Other columns don't matter.
    """
    spark = docs.sparkSession
    if path is not None and slot_map is None:
        if not _there(spark, path):
            SlotMap.first(shards, slots).save(spark, path)
        slot_map = SlotMap.load(spark, path)
    sized = stored(with_slot(docs, key, text, slot_map.slots if slot_map else slots))
    loads = slot_loads(sized)
    own = slot_map or SlotMap.build(loads, shards, slots)
    if path is not None:
        own.rebalanced(loads).save(spark, path)
        own = SlotMap.load(spark, path)
    first, rows = {}, [0] * own.shards
    for s in sorted(own.shard_of):
        first[s] = rows[own.shard_of[s]]
        rows[own.shard_of[s]] += loads.get(s, (0, 0))[1]
    places = spark.createDataFrame([(s, own.shard_of[s], first[s]) for s in sorted(own.shard_of)], "virtual_slot int, shard int, first long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(f"`{key}`"), "size", "text_crc32"))
    out = sized.withColumn("__rank", rank).join(F.broadcast(places), "virtual_slot")
    return out.select(F.col(f"`{key}`"), "size", "text_crc32", "shard", (F.col("first") + F.col("__rank") - 1).cast("long").alias("slot"), "virtual_slot", F.lit(own.version).alias("map_version")), own


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))
