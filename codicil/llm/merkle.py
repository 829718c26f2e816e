"""Merkle manifest of a dataset: a tree of hashes over the documents of each language, the tree of those trees, and a proof for every document.

A leaf is the hash of a row's fields. Leaves of a group stand in the order of their ids; every ``fanout`` consecutive nodes become their hash
until one is left (the last run may be shorter, of one node even). The groups' tops, in byte order of their names (null first), make one more tree.

Ranks come without a global sort. A key is a string of hexadecimal digits whose order is that of the rows. Histograms of prefixes of the key are made at
one depth, deep enough that no prefix holds more than MOST different rows, and summed up to shorter prefixes, STEP digits at a time; top down, each prefix
starts where its parent starts plus what stands before it there (a window over 16**STEP rows at most). A row's rank is its prefix's start plus its place
among the rows of the prefix. Rows that are alike in all hashed columns are counted as one row with a weight until they have their ranks.

The digits of a rank in base ``fanout`` are a node's path in the tree, so the nodes below one node share a prefix of them. LEAVES or fewer leaves with a common
prefix make one row; each pass hashes as many levels as such a row has and leaves one node of it for the next. Proofs go down the same way.

Rules: a null field is hashed as ``-``. Rows with a null id come first; equal ids go by their leaf; rows alike in every hashed column take consecutive places and
give the same leaf each. An empty table gives no rows. The id and ``n_chars`` must be integers (an error otherwise: an id that was cast would not be the one that was hashed).
"""

from __future__ import annotations

import hashlib
import math
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import arrow_map, crc_of_id, forget, settled

#: Different rows that share a prefix, at most; digits of a key taken at a time; leaves in a row, at most.
MOST, STEP, LEAVES = 2048, 3, 512
FIELDS = {"doc_id": T.IntegralType, "source": T.StringType, "lang": T.StringType, "n_chars": T.IntegralType, "text": T.StringType}


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(docs: DataFrame, **changed: Column) -> Column:
    return F.sha2(F.concat(*(field(changed.get(c, docs[c])) for c in FIELDS)), 256)


def hash_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def number_key(value: Column) -> Column:
    """Seventeen digits that sort as a long does, null first."""
    digits = F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.coalesce(F.concat(F.lit("1"), digits), F.lit("0" * 17))


def text_key(value: Column) -> Column:
    """Digits that sort as the UTF-8 bytes do, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.hex(F.encode(value, "UTF-8"))), F.lit("0"))


def radix_ranks(rows: DataFrame) -> DataFrame:
    """rows (a written table: g, key, m and others; each pair of g and key once) with ``rank``, the sum of m over smaller keys of g, and ``total``, that over all of g."""
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"), F.max(F.length("key")).alias("longest")).first()
    if not ends.n:
        return rows.withColumns({"rank": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    cut = lambda c, n: F.substring(F.col(c), 1, n)
    common = len(os.path.commonprefix([ends.low, ends.high]))
    depth = common + STEP * math.ceil(max(0.0, math.log(ends.n / MOST, 16)) / STEP)
    while True:
        counts = settled(rows.groupBy("g", cut("key", depth).alias("prefix")).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("rows")))
        if depth >= ends.longest or counts.agg(F.max("rows")).first()[0] <= MOST:
            break
        forget(counts)
        depth += STEP
    starts = counts.groupBy("g", cut("prefix", common).alias("prefix")).agg(F.sum("n").alias("total")).withColumn("start", F.lit(0).cast("long"))
    for n in range(common + STEP, depth + 1, STEP):
        level = counts.groupBy("g", cut("prefix", n).alias("prefix")).agg(F.sum("n").alias("n")).withColumn("parent", cut("prefix", n - STEP))
        before = F.sum("n").over(Window.partitionBy("g", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
        starts = level.join(starts.withColumnRenamed("prefix", "parent"), ["g", "parent"]).select("g", "prefix", "total", (F.col("start") + F.coalesce(before, F.lit(0))).alias("start"))
    before = F.sum("m").over(Window.partitionBy("g", "prefix").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("prefix", cut("key", depth)).join(starts, ["g", "prefix"])
    return placed.withColumn("rank", F.col("start") + F.coalesce(before, F.lit(0))).drop("prefix", "start")


def height(n: int, fanout: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def levels_in(total: int, r: int, fanout: int, steps: int) -> int:
    """Levels that pass r makes of a group with total leaves."""
    return min(steps, max(0, height(total, fanout) - r * steps))


def levels_of(hashes: list[str], fanout: int, levels: int) -> tuple[list[list[tuple[str, str]]], str]:
    """For each level the siblings left and right of each node, joined; the node on top."""
    beside = []
    for _ in range(levels):
        runs = [hashes[i : i + fanout] for i in range(0, len(hashes), fanout)]
        beside.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        hashes = [hash_of("".join(run)) for run in runs]
    return beside, hashes[0]


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof lead to. proof: levels parted by commas, in each the siblings left and right of the node, parted by a bar."""
    for level in proof.split(",") if proof else ():
        left, right = level.split("|")
        leaf = hash_of(left + leaf + right)
    return leaf


class Tree:
    """The trees of all groups. leaves: g, at (0 to total - 1, each once), total, hash and a struct ``body``."""

    def __init__(self, leaves: DataFrame, fanout: int):
        self.fanout, self.steps = fanout, max(1, int(math.log(LEAVES, fanout) + 1e-9))
        self.wide = fanout**self.steps
        most = leaves.agg(F.max("total")).first()[0] or 0
        self.rounds = max(1, -(-height(most, fanout) // self.steps))
        self.parts: list[DataFrame] = []
        nodes = leaves
        for r in range(self.rounds):
            rows = nodes.groupBy("g", F.expr(f"at div {self.wide}").alias("part")).agg(F.max("total").alias("total"), F.collect_list(F.struct("at", "hash", "body")).alias("nodes"))
            self.parts.append(settled(rows))
            if r + 1 < self.rounds:
                nodes = self.tops(r).withColumn("body", F.struct(F.lit(0).alias("none")))

    def tops(self, r: int = -1) -> DataFrame:
        """g, at, total, hash: what pass r leaves, the top of each group after the last."""
        r %= self.rounds
        fanout, steps = self.fanout, self.steps

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            tops = []
            for total, nodes in zip(batch.column("total").to_pylist(), batch.column("nodes").to_pylist()):
                hashes = [x["hash"] for x in sorted(nodes, key=lambda x: x["at"])]
                tops.append(levels_of(hashes, fanout, levels_in(total, r, fanout, steps))[1])
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "part", "total")), pa.array(tops, pa.string())], ["g", "at", "total", "hash"])

        return arrow_map(self.parts[r].select("g", "part", "total", F.transform("nodes", lambda x: F.struct(x["at"].alias("at"), x["hash"].alias("hash"))).alias("nodes")), run, "g string, at long, total long, hash string", rows=64)

    def proofs(self, above: DataFrame) -> DataFrame:
        """at, hash, body and proof of each leaf; above: g, proof (what leads on from the top of the group) and other columns, which come along."""
        extra = [c for c in above.columns if c not in ("g", "proof")]
        above = above.withColumn("part", F.lit(0).cast("long"))
        fanout, steps = self.fanout, self.steps
        for r in reversed(range(self.rounds)):
            rows = self.parts[r].join(above, ["g", "part"])
            body = self.parts[r].schema["nodes"].dataType.elementType["body"].dataType.simpleString()
            kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in extra)

            form = T.StructType.fromDDL(f"g string, part long, hash string, body {body}, proof string{kinds}")
            schema = to_arrow_schema(form)

            def run(batch: pa.RecordBatch, r: int = r, schema: pa.Schema = schema) -> pa.RecordBatch:
                out: dict[str, list] = {c: [] for c in ("g", "part", "hash", "body", "proof", *extra)}
                columns = [batch.column(c).to_pylist() for c in ("g", "total", "nodes", "proof", *extra)]
                for g, total, nodes, proof, *more in zip(*columns):
                    nodes = sorted(nodes, key=lambda x: x["at"])
                    beside, _ = levels_of([x["hash"] for x in nodes], fanout, levels_in(total, r, fanout, steps))
                    for i, x in enumerate(nodes):
                        own = ["|".join(level[i // fanout**s]) for s, level in enumerate(beside)]
                        for c, v in zip(out, (g, x["at"], x["hash"], x["body"], ",".join([*own, *([proof] if proof else [])]), *more)):
                            out[c].append(v)
                return pa.RecordBatch.from_pydict(out, schema=schema)

            above = arrow_map(rows, run, form, rows=16)
            if r:
                above = above.drop("hash", "body")
        return above.withColumnRenamed("part", "at")


def manifest(docs: DataFrame, fanout: int = 2, other_n_chars: Column | None = None) -> DataFrame:
    """doc_id, lang, rank (in its language), leaf, proof, subroot, root of each row; ``other_leaf``: the leaf with other_n_chars in place of n_chars (the leaf itself if it isn't given).

    docs: doc_id, source, lang, n_chars, text; further columns are left behind."""
    if fanout < 2:
        raise ValueError("fanout: 2 or more")
    for c, kind in FIELDS.items():
        if not isinstance(docs.schema[c].dataType, kind | T.NullType):
            raise TypeError(f"{c} is {docs.schema[c].dataType.simpleString()}; a manifest needs {kind.__name__}")
    docs = docs.select(*FIELDS)
    leaf = leaf_of(docs)
    other = leaf if other_n_chars is None else F.when(other_n_chars.eqNullSafe(docs.n_chars), leaf).otherwise(leaf_of(docs, n_chars=other_n_chars))
    hashed = docs.select(text_key(F.col("lang")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf.alias("leaf"), other.alias("other"))
    alike = settled(hashed.groupBy("g", F.concat(number_key(F.col("doc_id")), F.upper("leaf")).alias("key")).agg(F.count(F.lit(1)).alias("m"), F.struct(*(F.first(c).alias(c) for c in ("doc_id", "lang", "leaf", "other"))).alias("body")))
    ranked = settled(radix_ranks(alike))
    # a row alike many others takes their places, LEAVES of them at a time
    spans = ranked.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / LEAVES))))
    place = F.explode(F.sequence(F.col("span") * LEAVES, F.least(F.col("m"), (F.col("span") + 1) * LEAVES) - 1))
    leaves = spans.withColumn("place", place).select("g", (F.col("rank") + F.col("place")).alias("at"), "total", F.col("body.leaf").alias("hash"), "body")
    trees = Tree(leaves, fanout)
    forget(alike)
    forget(ranked)
    tops = settled(trees.tops().select(F.lit("").alias("g"), F.col("g").alias("key"), F.lit(1).cast("long").alias("m"), "hash"))
    groups = Tree(radix_ranks(tops).select("g", F.col("rank").alias("at"), "total", "hash", F.struct("key").alias("body")), fanout)
    whole = groups.tops().select("g", F.lit("").alias("proof"), F.col("hash").alias("root"))
    named = groups.proofs(whole).select(F.col("body.key").alias("g"), "proof", F.col("hash").alias("subroot"), "root")
    proved = trees.proofs(settled(named))
    return proved.select("body.doc_id", "body.lang", F.col("at").alias("rank"), F.col("hash").alias("leaf"), F.col("body.other").alias("other_leaf"), "proof", "subroot", "root")


def folded(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """rows of a manifest with proof_sha256 (of all siblings), folded_root (from the leaf in the column named) and verified (is it the root?)."""
    own = [c for c in rows.columns if c not in ("proof_sha256", "folded_root", "verified")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        proofs, leaves = batch.column("proof").to_pylist(), batch.column(leaf).to_pylist()
        beside = [hash_of(p.replace(",", "").replace("|", "")) for p in proofs]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(beside, pa.string()), pa.array(list(map(fold, leaves, proofs)), pa.string())], [*own, "proof_sha256", "folded_root"])

    schema = T.StructType([*(rows.schema[c] for c in own), T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())])
    return arrow_map(rows.select(*own), run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """The manifest and its check against tampered rows: where 7 divides crc32 of the id, one is added to n_chars before the leaf is folded again."""
    tampered = F.when(crc_of_id(docs["doc_id"].cast("long")) % 7 == 0, docs["n_chars"] + 1).otherwise(docs["n_chars"])
    return folded(manifest(docs, fanout, tampered), "other_leaf")
