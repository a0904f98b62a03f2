"""Splits that keep related records together: hash-to-min components, then weighted rendezvous hashing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import BLANKS, ensure_checkpoint_dir

#: Words that name nobody and nothing, spelled without marks. A corpus with others hands in its own list.
NOBODY = ["", "unknown", "none", "null", "nil", "nan", "na", "tbd", "tba", "anon", "anonymous", "notrecorded", "pending", "missing", "empty", "undefined", "notavailable", "notapplicable", "nobody", "noname", "unnamed", "todo", "test", "unspecified", "redacted"]
#: Components above this share of all frames are placed first, largest first; there are at most 1/share of them.
HEAVY_SHARE = 0.002


def _letters(c: Column) -> Column:
    wide = "".join(chr(x) for x in range(0xFF10, 0xFF5B))
    thin = "".join(chr(ord(x) - 0xFEE0) for x in wide)
    return F.regexp_replace(F.lower(F.translate(c, wide, thin)), f"{BLANKS}|[^\\p{{L}}\\p{{N}}]", "")


def spelled(c: Column, prefix: str, nobody: Sequence[str] = NOBODY) -> Column:
    """A name without case, blanks and marks; a leading word of what it is (subject, author, sha256) falls away. Null
    where it names nobody: null, blank, marks alone, a word for nothing, only zeros."""
    bare = F.regexp_replace(_letters(c), f"^(?:{prefix})(?=.)", "")
    plain = F.regexp_replace(_letters(c), f"^(?:{prefix})$", "")
    named = F.when(plain == "", "").otherwise(bare)
    return F.when(named.isin(list(nobody)) | named.rlike("^0+$"), None).otherwise(named)


#: Words that may stand before a subject, an author or a digest without being part of it.
PREFIXES = {"subject": "subject|subj|sub(?=s?\\d)", "author": "author|auth(?=[a-z]+\\d)", "source_bag_sha256": "sha256|sha(?=[0-9a-f]{64})"}


def session_links(catalog: DataFrame, nobody: Sequence[str] = NOBODY, prefixes: Mapping[str, str] = PREFIXES) -> DataFrame:
    """(sid, token): the subjects, authors and source bags of each sid, spelling aside; a sid listed twice has those of
    both rows. Rows without sid are left out."""
    return (
        catalog.filter("sid is not null")
        .select(
            "sid",
            F.explode(
                F.array(*[F.concat(F.lit(f"{c[0]}:"), spelled(F.col(c), p, nobody)) for c, p in prefixes.items()])
            ).alias("token"),
        )
        .filter("token is not null")
        .distinct()
    )


def hash_to_min(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): connected components of undirected edges (a, b), component = the smallest node.

    Each node holds a cluster of nodes as rows. In a round it sends the whole cluster to the cluster's smallest node and
    that smallest node to every member; after O(log n) rounds each node holds its component's smallest and the smallest
    holds all. A cluster is never gathered in one task: its minimum is a partial aggregate, its rows meet that minimum
    in a join that adaptive execution may split. Every round is checkpointed in the shared folder; two sums tell the
    driver whether anything changed; more than ``max_rounds`` rounds (far beyond the logarithm of any graph) are an error.
    Self-loops keep a node without neighbours; null ends are left out.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select("a", "b").filter("a is not null and b is not null")
    pairs = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = pairs.select("a", F.col("a").alias("b"))
    clusters = pairs.unionByName(own).distinct().checkpoint()
    before = None
    for _ in range(max_rounds):
        low = clusters.groupBy("a").agg(F.min("b").alias("m"))
        sent = clusters.join(low, "a").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        clusters = sent.distinct().checkpoint()
        now = clusters.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return clusters.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def session_components(catalog: DataFrame, nobody: Sequence[str] = NOBODY) -> DataFrame:
    """(sid, component) of every sid. A token is a star from its smallest sid, so one that a third of the sessions share
    gives as many edges as sessions, not their square."""
    links = session_links(catalog, nobody)
    star = links.groupBy("token").agg(F.min("sid").alias("hub"))
    edges = links.join(star, "token").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
    alone = catalog.filter("sid is not null").select(F.col("sid").alias("a"), F.col("sid").alias("b")).distinct()
    return hash_to_min(edges.unionByName(alone)).select(F.col("node").alias("sid"), "component")


def rendezvous(key: Column, weights: dict[str, float], seed: int = 17) -> Column:
    """The name with the largest -w / ln(u), u a uniform hash of key and name: each gets its weight's part of the keys, and
    a changed weight moves only what it must. Names with no weight get nothing; without any weight null."""
    scores = []
    for name, w in sorted(weights.items()):
        if w > 0:
            u = (F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
            scores.append(F.struct((-w / F.log(u)).alias("s"), F.lit(name).alias("n")))
    return F.array_max(F.array(*scores))["n"] if scores else F.lit(None).cast("string")


def session_frames(catalog: DataFrame, meta: DataFrame) -> DataFrame:
    """(sid, frames): the distinct frames of meta_frames; for a sid without any, the largest usable frame_count, else 0."""
    seen = meta.filter("frame_index is not null").select("session_id", "frame_index").distinct().groupBy("session_id").agg(F.count("*").alias("seen"))
    listed = catalog.filter("sid is not null").groupBy("sid").agg(F.max(F.greatest(F.col("frame_count"), F.lit(0))).alias("told"))
    return listed.join(seen, listed["sid"] == seen["session_id"], "left").select("sid", F.coalesce("seen", "told", F.lit(0)).cast("bigint").alias("frames"))


def assign_splits(sessions: DataFrame, targets: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(sid, component, split_name, frames) for sessions (sid, component, frames) and targets (split_name, split_share).

    Components go to splits whole, by rendezvous hashing weighted with what each split still lacks. A component above
    ``heavy_share`` of all frames would upset the shares by chance alone, so these few (at most 1/heavy_share) are placed
    first, largest first, where most frames are lacking in proportion; the rest is hashed onto what remains.
    Shares need not add up to 1; null, negative or repeated targets: nulls and negatives count as 0, repeats add up.
    """
    shares: dict[str, float] = {}
    for r in targets.filter("split_name is not null").select("split_name", "split_share").collect():
        w = r[1] if r[1] is not None and r[1] > 0 and not math.isnan(r[1]) else 0.0
        shares[r[0]] = shares.get(r[0], 0.0) + w
    total_share = sum(shares.values()) or 1.0
    size = sessions.groupBy("component").agg(F.sum("frames").alias("size"))
    total = size.agg(F.sum("size")).first()[0] or 0
    lacking = {n: total * w / total_share for n, w in shares.items()}
    placed: dict[str, str] = {}
    if total and shares:
        for r in size.filter(F.col("size") > heavy_share * total).orderBy(F.desc("size"), "component").collect():
            to = max(sorted(lacking), key=lambda n: (lacking[n] >= r["size"], lacking[n] / (shares[n] or math.inf), lacking[n]))
            placed[r["component"]], lacking[to] = to, lacking[to] - r["size"]
    weights = {n: max(v, 0.0) for n, v in lacking.items()} if any(v > 0 for v in lacking.values()) else shares
    choice = rendezvous(F.col("component"), weights)
    if placed:
        known = F.create_map(*[F.lit(x) for kv in sorted(placed.items()) for x in kv])
        choice = F.coalesce(F.try_element_at(known, F.col("component")), choice)
    return sessions.select("sid", "component", choice.alias("split_name"), "frames")


def session_splits(catalog: DataFrame, meta: DataFrame, targets: DataFrame) -> DataFrame:
    """The split of every session; all its frames and all related sessions share it."""
    sessions = session_components(catalog).join(session_frames(catalog, meta), "sid")
    ensure_checkpoint_dir(catalog.sparkSession)
    return assign_splits(sessions.checkpoint(), targets)
