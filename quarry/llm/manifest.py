"""A Merkle manifest of a table as a rollup of nested structs.

Every row is a leaf digest, and per group (a language) the leaves ascend by id.
A leaf's rank is written as digits of base 8 under a block number. The digit
columns are grouped away one after the other, so that each step nests eight
child structs into their parent with its digest; the last one leaves one nested
struct per block of 8^3 leaves. A block's root is a leaf of the next tier, which
has a 512th of the rows, until each group has one block; the groups' roots are
then the leaves of one more such tree. Proofs come down the tiers the same way:
the steps above a block meet its nested struct in a grouping by block, and one
transform and explode per digit hand them to the children, each with the digests
beside it. No join attaches a proof.

A tier is dealt by (group, block), which serves all its groupings. Leaves are
numbered by a range partitioning of narrow rows: ids, two digests, no texts. The
number of rows of a block is bounded, whatever a group's size.

Defined cases: a null value is `-` in the digest; null groups come first; null
ids come first in their group; rows of one id are ordered by digest, and equal
rows are leaves of their own; a null id is not tampered with; a group of one row
has its leaf as subroot; an empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise

FAN = 8
#: Digits that one tier groups away; a block has FAN ** DIGITS nodes at most.
DIGITS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"
#: What comes down the tiers: the two roots that all rows below share, and the digests beside the way, the lowest first.
_WAY = f"struct<subroot:string,root:string,steps:{_STEPS}>"


def digest_of(*values: Column) -> Column:
    """The hex SHA-256 of the values: `-` for null, else UTF-8 byte count, colon and value."""
    coded = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def _joined(hashes: Column) -> Column:
    return F.sha2(F.concat_ws("", hashes).cast("binary"), 256)


def _ranked(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`leaves` with rank, the place in its group from 0, and n, the size of the group; group keys may be null."""
    # The row number spreads equal rows over ranges; the sort orders rows by it only where all else is equal.
    numbered = leaves.withColumn("nth", F.monotonically_increasing_id())
    runs = numbered.repartitionByRange(group, *order, "nth").sortWithinPartitions(group, *order, "nth")
    runs = materialise(runs.drop("nth").withColumn("at", F.monotonically_increasing_id()), "manifest-runs")
    runs = runs.withColumn("run", F.shiftright("at", 33))
    # One row per run and group that it holds.
    counts = runs.groupBy("run", group).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("run").alias("its_run"), F.col(group).alias("its_group"),
                            (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                            F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    return (runs.join(offsets, (F.col("run") == F.col("its_run")) & F.col(group).eqNullSafe(F.col("its_group")))
            .withColumn("rank", F.col("at") + F.col("shift")).drop("run", "at", "shift", "its_run", "its_group"))


def _nest(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(g, n, block, node): one row per block of `nodes` (g, n, rank, hash, payload); `node` is the nested struct.

    A level whose group is down to one node hashes nothing: its node is the child itself, with `done` set.
    """
    keys = ["g", "n", "block", *[f"d{i}" for i in reversed(range(DIGITS))]]
    level = nodes.select("g", "n", F.expr(f"rank div {FAN ** DIGITS}").alias("block"),
                         *[F.expr(f"CAST(rank div {FAN ** i} % {FAN} AS INT)").alias(f"d{i}") for i in range(DIGITS)],
                         F.struct("hash", *payload).alias("node"))
    level = level.repartition("g", "block")
    for i in range(DIGITS):
        level = (level.groupBy(*keys[:3 + DIGITS - 1 - i])
                 .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("digit"), "node"))), lambda x: x["node"]).alias("children")))
        hashed = F.col("n") > FAN ** i
        level = level.withColumn("node", F.struct(
            F.when(hashed, _joined(F.transform("children", lambda c: c["hash"]))).otherwise(F.col("children")[0]["hash"]).alias("hash"),
            (~hashed).alias("done"), "children")).drop("children")
    return level


def _hand_down(nested: DataFrame, above: DataFrame, payload: list[str]) -> DataFrame:
    """(g, rank, hash, way, payload) of every node of a tier, from its nested blocks and the ways (g, block, way) to them."""
    met = (nested.select("g", "block", "node", F.lit(None).cast(_WAY).alias("way"))
           .unionByName(above.select("g", "block", F.col("way").cast(_WAY).alias("way")), allowMissingColumns=True)
           .groupBy("g", "block").agg(F.collect_list("node")[0].alias("node"), F.collect_list("way")[0].alias("way")))
    level = met.select("g", F.col("block").alias("rank"), "node", "way")
    for _ in range(DIGITS):
        hashes = F.transform("node.children", lambda c: c["hash"])

        def child(c: Column, i: Column) -> Column:
            beside = F.struct(F.concat_ws("", F.slice(hashes, F.lit(1), i)).alias("before"),
                              F.concat_ws("", F.slice(hashes, i + 2, F.greatest(F.size(hashes) - i - 1, F.lit(0)))).alias("after"))
            below = F.struct("way.subroot", "way.root", F.concat(F.array(beside), F.col("way.steps")).alias("steps"))
            return F.struct((F.col("rank") * FAN + i).alias("rank"), c.alias("node"), F.when(F.col("node.done"), F.col("way")).otherwise(below).alias("way"))

        level = level.select("g", F.explode(F.transform("node.children", child)).alias("x")).select("g", "x.*")
    return level.select("g", "rank", F.col("node.hash").alias("hash"), "way", *[F.col(f"node.{c}").alias(c) for c in payload])


def _tree(leaves: DataFrame, payload: list[str], largest: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """The roots (g, hash) and the nested tiers, the leaves' first; `leaves` has g, n, rank, hash and the payload."""
    tiers, nodes, extra = [], leaves, payload
    while True:
        # A tier is read twice, on the way up and down.
        nested = materialise(_nest(nodes, extra), f"manifest-{name}-{len(tiers)}")
        tiers.append(nested)
        if largest <= FAN ** DIGITS:
            return nested.select("g", F.col("node.hash").alias("hash")), tiers
        largest = -(-largest // FAN ** DIGITS)
        nodes = nested.select("g", F.expr(f"(n + {FAN ** DIGITS - 1}) div {FAN ** DIGITS}").alias("n"),
                              F.col("block").alias("rank"), F.col("node.hash").alias("hash"))
        extra = []


def _proofs(tiers: list[DataFrame], above: DataFrame, payload: list[str]) -> DataFrame:
    """The leaves with their ways; `above` (g, way) has the way to each root."""
    ways = above.select("g", F.lit(0).cast("long").alias("block"), "way")
    for i, nested in reversed(list(enumerate(tiers))):
        found = _hand_down(nested, ways, payload if i == 0 else [])
        ways = found.select("g", F.col("rank").alias("block"), "way")
    return found


def merkle_manifest(leaves: DataFrame, group: str, order: list[str], hash_col: str = "leaf", carry: tuple[str, ...] = ()) -> DataFrame:
    """(group, rank, leaf, subroot, root, steps, *order, *carry): every leaf with the digests beside its way to the root, the lowest first.

    Jobs run when it is called: two numbers come to the driver, the size of the largest group and the number of groups.
    """
    payload = list(dict.fromkeys([*order, *carry]))
    numbered = _ranked(leaves.select(F.col(group).alias("g"), F.col(hash_col).alias("hash"), *payload), "g", [*order, "hash"])
    numbered = materialise(numbered, "manifest-leaves")
    largest = numbered.agg(F.max("n")).first()[0] or 0
    roots, tiers = _tree(numbered, payload, largest, "rows")
    # The groups' roots are the leaves of one more tree, with one group.
    tops = _ranked(roots.select(F.lit(0).alias("one"), F.col("g").alias("key"), "hash"), "one", ["key"]).withColumnRenamed("one", "g")
    tops = materialise(tops, "manifest-tops")
    count = tops.agg(F.max("n")).first()[0] or 0
    top, top_tiers = _tree(tops, ["key"], count, "groups")
    start = F.struct(F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"), F.array().cast(_STEPS).alias("steps"))
    above = _proofs(top_tiers, top.select("g", start.alias("way")), ["key"])
    above = above.select(F.col("key").alias("g"), F.struct(F.col("hash").alias("subroot"), "way.root", "way.steps").alias("way"))
    return _proofs(tiers, above, payload).select(F.col("g").alias(group), "rank", F.col("hash").alias(hash_col), "way.*", *payload)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the digests beside its way give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """The SHA-256 of all digests beside the way, level by level, left to right."""
    return _joined(F.transform(steps, lambda s: F.concat(s["before"], s["after"])))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of `docs`, checked against tampered rows.

    Where 3 divides the CRC-32 of the decimal id, the checked text has its
    capitals lowered; the proof is that of the original.
    """
    fields = [F.col(c).cast("string") for c in FIELDS]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = F.when(touched, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "lang", digest_of(*fields).alias("leaf"), digest_of(*fields[:-1], seen).alias("seen"))
    # Texts are read once: the range partitioning samples its input.
    leaves = materialise(leaves, "manifest-digests")
    found = merkle_manifest(leaves, "lang", ["doc_id"], carry=("seen",))
    folded = fold(F.col("seen"), F.col("steps"))
    return (found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
