"""Operator 12: a Merkle manifest of a dataset by time-forward processing.

Nodes have labels (level, place) and are worked on in label order. A node sends its digest to its parent's
label; a priority queue hands out the messages of the smallest label, so a parent finds its children's
digests together, without looking anything up. A reversed sweep starts at the top and sends every node the
suffix of its proof (siblings from its parent up to the root).

The queue is external. Leaves are ranked by one range sort and dealt to blocks of 2 ** `LEVELS` consecutive ones,
which are whole subtrees; a block's messages pass through a heap of its own, and what leaves a block, one
digest, is a message to the next round's table, which Spark sorts and deals into blocks again. So n leaves
take log2(n) / LEVELS rounds up and as many down, no task holds more than a block, and a block's rows move
once for each sweep. Languages' subroots are the leaves of one more tree, built by the same rounds.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ranks import dense_index
from . import common

#: Levels that a block climbs: it has 2 ** LEVELS leaves, as runs are pairs.
LEVELS = 10
#: A step of a proof: which side the sibling is on (none for a run of one), and its digest.
ALONE, LEFT, RIGHT = 0, 1, 2
STEP = 33


def _hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


# ---------------------------------------------------------------------------
# Sweeps inside a block
# ---------------------------------------------------------------------------


def rise(leaves: list[str], levels: int | None) -> dict[tuple[int, int], str]:
    """Digests by label after `levels` levels, or, if None, up to the level of one node."""
    found: dict[tuple[int, int], str] = {}
    # a message: level and place of the node it goes to, which child sends it, digest; sorted, so a heap
    queue = [(0, i, 0, digest) for i, digest in enumerate(leaves)]
    top = (len(leaves) - 1).bit_length() if levels is None else levels
    while queue:
        level, place, _, digest = heapq.heappop(queue)
        if level:
            run = [digest]
            while queue and queue[0][0] == level and queue[0][1] == place:
                run.append(heapq.heappop(queue)[3])
            digest = _hash(*run)
        found[level, place] = digest
        if level < top:
            heapq.heappush(queue, (level + 1, place >> 1, place & 1, digest))
    return found


def descend(found: dict[tuple[int, int], str], suffix: tuple | None) -> list[tuple | None]:
    """For each leaf, its siblings up to the block's top and then `suffix`, as linked (side, digest, further)."""
    top = max(found)
    out: dict[int, tuple | None] = {}
    queue = [(-top[0], -top[1], suffix)]
    while queue:
        level, place, further = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            out[place] = further
            continue
        left, right = (level - 1, 2 * place), (level - 1, 2 * place + 1)
        if right in found:
            heapq.heappush(queue, (-left[0], -left[1], (RIGHT, found[right], further)))
            heapq.heappush(queue, (-right[0], -right[1], (LEFT, found[left], further)))
        else:
            heapq.heappush(queue, (-left[0], -left[1], (ALONE, "", further)))
    return [out[i] for i in range(len(out))]


def _packed(steps: tuple | None) -> bytes:
    parts = []
    while steps:
        side, digest, steps = steps
        parts.append(bytes([side]) + (bytes.fromhex(digest) if side else bytes(STEP - 1)))
    return b"".join(parts)


def _unpacked(data: bytes) -> tuple | None:
    steps = None
    for at in range(len(data) - STEP, -1, -STEP):
        side = data[at]
        steps = (side, data[at + 1:at + STEP].hex() if side else "", steps)
    return steps


def siblings(steps: tuple | None) -> list[str]:
    out = []
    while steps:
        side, digest, steps = steps
        if side:
            out.append(digest)
    return out


def fold(digest: str, steps: tuple | None) -> str:
    """The root that a leaf and its proof lead to."""
    while steps:
        side, other, steps = steps
        digest = _hash(digest) if side == ALONE else _hash(other, digest) if side == LEFT else _hash(digest, other)
    return digest


# ---------------------------------------------------------------------------
# Forests
# ---------------------------------------------------------------------------


def _placed(nodes: DataFrame, order: list[str], group: str | None) -> DataFrame:
    """`nodes` with `grp`, place in the group (`pos`, by `order`) and size of the group (`many`)."""
    nodes = nodes.withColumn("grp", F.col(group) if group else F.lit(None).cast("string"))
    # rows that are equal in every way are told apart, so that they do not fill one range of the sort
    ranked = dense_index(nodes.withColumn("__row", F.monotonically_increasing_id()), ["grp", *order, "__row"], "__at").drop("__row")
    groups = ranked.groupBy("grp").agg(F.min("__at").alias("first"), F.count("*").alias("many")).withColumnRenamed("grp", "of")
    return (ranked.join(groups, F.col("grp").eqNullSafe(F.col("of")))
            .withColumn("pos", F.col("__at") - F.col("first")).drop("__at", "first", "of"))


def _blocks(nodes: DataFrame, payload: list[str], levels: int) -> DataFrame:
    """One row per block of `nodes(grp, pos, many, ...)`, its members' columns as arrays in order."""
    member = F.struct("pos", *payload)
    rows = nodes.groupBy("grp", F.shiftright("pos", levels).alias("block")).agg(
        F.first("many").alias("many"), F.sort_array(F.collect_list(member)).alias("m"))
    return common.saved(rows.select("grp", "block", "many", *[F.col(f"m.{c}").alias(c) for c in payload]), "merkle-blocks")


def _height(many: int, levels: int) -> int | None:
    """How far a block of a group of `many` climbs: to its end if it is the only one."""
    return None if many <= 1 << levels else levels


def _tops(blocks: DataFrame, levels: int) -> DataFrame:
    """`grp, pos, many, digest`: what each block sends up. `many` counts the nodes of the next round."""
    def climb(batches):
        for batch in batches:
            leaves, many = batch.column(3), batch.column(2).to_pylist()
            tops = []
            for i, n in enumerate(many):
                found = rise([x.hex() for x in leaves[i].as_py()], _height(n, levels))
                tops.append(bytes.fromhex(found[max(found)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([-(-n >> levels) for n in many], pa.int64()), pa.array(tops, pa.binary())],
                ["grp", "pos", "many", "digest"])

    return blocks.select("grp", "block", "many", "digest").mapInArrow(climb, "grp string, pos long, many long, digest binary")


def _raise(nodes: DataFrame, payload: list[str], most: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and `grp, digest` of what remains of each group. `most` is the largest group."""
    rounds, done = [], None
    while True:
        blocks = _blocks(nodes, payload, levels)
        rounds.append(blocks)
        tops = common.saved(_tops(blocks, levels), "merkle-tops")
        # after the last round of its group a block is alone
        ended = tops.where("many = 1").select("grp", "digest")
        done = ended if done is None else done.unionByName(ended)
        most = -(-most >> levels)
        if most <= 1:
            return rounds, done
        nodes, payload = tops.where("many > 1"), ["digest"]


def _with_suffix(blocks: DataFrame, ends: DataFrame, inner: DataFrame | None, levels: int) -> DataFrame:
    """`blocks` with `suffix` and `subroot`: from `ends(grp, ...)` where a group ended, else from the round above."""
    def joined(rows, by, keys):
        for k in keys:
            by = by.withColumnRenamed(k, f"__{k}")
        same = F.col("grp").eqNullSafe(F.col("__grp"))
        if "block" in keys:
            same = same & (F.col("block") == F.col("__block"))
        return rows.join(by, same).drop(*[f"__{k}" for k in keys])

    alone = F.col("many") <= 1 << levels
    last = joined(blocks.where(alone), ends, ["grp"])
    if inner is None:
        return last
    return last.unionByName(joined(blocks.where(~alone), inner, ["grp", "block"]))


def _lower(rounds: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """Round 0's blocks with the suffixes that reach their tops; `ends(grp, suffix, subroot)` has those of whole groups."""
    def sink(batches):
        for batch in batches:
            names = batch.schema.names
            c = {n: batch.column(i) for i, n in enumerate(names)}
            for i, n in enumerate(c["many"].to_pylist()):
                leaves = [x.hex() for x in c["digest"][i].as_py()]
                start = c["block"][i].as_py() << levels
                suffixes = descend(rise(leaves, _height(n, levels)), _unpacked(c["suffix"][i].as_py()))
                size = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c["grp"][i].as_py()] * size, pa.string()), pa.array(range(start, start + size), pa.int64()),
                     pa.array(map(_packed, suffixes), pa.binary()), pa.array([c["subroot"][i].as_py()] * size, pa.binary())],
                    ["grp", "block", "suffix", "subroot"])

    inner = None
    for blocks in reversed(rounds[1:]):
        wide = _with_suffix(blocks, ends, inner, levels).select("grp", "block", "many", "digest", "suffix", "subroot")
        inner = common.saved(wide.mapInArrow(sink, "grp string, block long, suffix binary, subroot binary"), "merkle-suffixes")
    return _with_suffix(rounds[0], ends, inner, levels)


# ---------------------------------------------------------------------------
# The manifest
# ---------------------------------------------------------------------------


def _field(value: Column) -> Column:
    """A leaf's field: `-` if null, else byte count, colon, value."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def _leaf(n_chars: Column) -> Column:
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang")] + [_field(n_chars), _field(F.col("text"))]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """`lang, doc_id, digest, forged`: leaf digests, and those after tampering where 7 divides the id's crc32."""
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")
    return docs.select("lang", "doc_id", _leaf(F.col("n_chars")).alias("digest"), F.when(touched, _leaf(more)).alias("forged"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """`doc_id, leaf, subroot, root, proof_sha256, folded_root, verified` of every row of `docs(doc_id, source, lang, n_chars, text)`.

    A leaf hashes the five fields; a language's leaves in the order of their ids, and then the languages'
    subroots in the order of their names (null first), are hashed in pairs, a last odd one alone, until one
    is left. `proof_sha256` hashes a leaf's siblings from its level up to the root.

    Nulls: a null field is `-`; a null language is a group of its own; null ids come first and are not
    tampered with, nor is a null `n_chars`. Repeated ids go in the order of their leaf digests; equal rows
    are leaves of their own. Empty texts have 0 bytes, texts of any length are hashed whole. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    common.ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    hashed = common.saved(leaves(docs), "merkle-leaves")
    nodes = _placed(hashed, ["doc_id", "digest"], "lang")
    most = hashed.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    rounds, subroots = _raise(nodes, ["doc_id", "digest", "forged"], most, levels)
    subroots = common.saved(subroots.select(F.col("grp").alias("lang"), "digest"), "merkle-subroots")
    above, top = _raise(_placed(subroots, ["lang"], None), ["lang", "digest"], subroots.count(), levels)
    found = top.first()
    root = bytes(found["digest"]).hex() if found else ""
    whole = spark.createDataFrame([(None, b"", b"")], "grp string, suffix binary, subroot binary")
    ends = _language_suffixes(_lower(above, whole, levels), levels)
    shaped = _lower(rounds, ends, levels).select("doc_id", "digest", "forged", "many", "suffix", "subroot")

    def prove(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, n in enumerate(c["many"].to_pylist()):
                own = [x.hex() for x in c["digest"][i].as_py()]
                steps = descend(rise(own, _height(n, levels)), _unpacked(c["suffix"][i].as_py()))
                forged = c["forged"][i].as_py()
                folded = [fold(f.hex() if f else d, s) for d, f, s in zip(own, forged, steps)]
                yield pa.RecordBatch.from_arrays(
                    [c["doc_id"].slice(i, 1).flatten(), pa.array(own), pa.array([c["subroot"][i].as_py().hex()] * len(own)),
                     pa.array([root] * len(own)), pa.array([_hash(*siblings(s)) for s in steps]), pa.array(folded),
                     pa.array([f == root for f in folded], pa.bool_())],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return shaped.mapInArrow(prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                    "folded_root string, verified boolean")


def _language_suffixes(blocks: DataFrame, levels: int) -> DataFrame:
    """`grp, suffix, subroot` of every language, from the blocks of the tree over the languages."""
    def sink(batches):
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, n in enumerate(c["many"].to_pylist()):
                digests = c["digest"][i].as_py()
                steps = descend(rise([x.hex() for x in digests], _height(n, levels)), _unpacked(c["suffix"][i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [c["lang"].slice(i, 1).flatten(), pa.array(map(_packed, steps), pa.binary()), pa.array(digests, pa.binary())],
                    ["grp", "suffix", "subroot"])

    wide = blocks.select("lang", "digest", "many", "suffix")
    return common.saved(wide.mapInArrow(sink, "grp string, suffix binary, subroot binary"), "merkle-languages")


def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(common.table(spark, sf, "documents"))


def _crc32_sql(value: str) -> str:
    """CRC-32 (reversed polynomial 0xEDB88320) of a short ASCII text, bit by bit."""
    byte = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}, ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: " \
           "list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))"
    return f"xor({byte}, 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


OP12_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars::HUGEINT + 1")} END AS forged
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS grp FROM leaves
), low AS (
  SELECT 0 AS lvl, grp, pos, leaf AS digest, count(*) OVER (PARTITION BY grp) AS many FROM placed
  UNION ALL
  SELECT lvl + 1, grp, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(many) + 1) // 2
  FROM low WHERE many > 1 GROUP BY lvl, grp, pos // 2
), lows AS MATERIALIZED (SELECT * FROM low),
high AS (
  SELECT 0 AS lvl, grp AS pos, digest, count(*) OVER () AS many FROM lows WHERE many = 1
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(many) + 1) // 2
  FROM high WHERE many > 1 GROUP BY lvl, pos // 2
), highs AS MATERIALIZED (SELECT * FROM high),
heights AS (SELECT grp, max(lvl) AS h FROM lows GROUP BY grp),
nodes AS MATERIALIZED (
  -- one address for both trees: those of the upper one lie above the language's own levels
  SELECT lvl, grp, pos, digest FROM lows WHERE many > 1
  UNION ALL
  SELECT h + u.lvl, g.grp, u.pos, u.digest FROM heights g JOIN highs u ON u.many > 1 AND (u.pos // 2 = (g.grp >> u.lvl) // 2)
), steps AS (
  SELECT 0 AS lvl, p.doc_id, p.grp, p.pos, p.pos AS cur, h.h, coalesce(p.forged, p.leaf) AS folded, '' AS proof, p.leaf
  FROM placed p JOIN heights h USING (grp)
  UNION ALL
  SELECT s.lvl + 1, s.doc_id, s.grp, s.pos, here // 2, s.h,
         sha256(CASE WHEN n.digest IS NULL THEN s.folded WHEN here % 2 = 0 THEN s.folded || n.digest ELSE n.digest || s.folded END),
         s.proof || coalesce(n.digest, ''), s.leaf
  FROM (SELECT *, CASE WHEN lvl = h THEN grp ELSE cur END AS here FROM steps) s
  LEFT JOIN nodes n ON n.lvl = s.lvl AND n.grp = s.grp AND n.pos = xor(here, 1)
  WHERE s.lvl < s.h + (SELECT max(lvl) FROM highs)
)
SELECT s.doc_id, s.leaf, sub.digest AS subroot, r.digest AS root, sha256(s.proof) AS proof_sha256, s.folded AS folded_root,
       s.folded = r.digest AS verified
FROM steps s JOIN (SELECT grp, digest FROM lows WHERE many = 1) sub USING (grp), (SELECT digest FROM highs WHERE many = 1) r
WHERE s.lvl = s.h + (SELECT max(lvl) FROM highs)
"""
