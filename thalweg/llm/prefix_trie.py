"""Prefix trie of conversations by distributed MSD radix partitioning over dictionary-encoded turn ids.

`encode` numbers the distinct turns (role, text) in their own order and turns every conversation into the
sequence of its turn ids. `trie` puts equal sequences into one class and then recurses from the root: rows of a
bucket share a prefix; a bucket of more than `local` turns skips the prefix that its smallest and largest
sequence have in common and is dealt out by the next turn id; smaller buckets are finished in tasks by
multikey quicksort, whose recursion emits their nodes. Totals of subtrees go up the rounds again, one row for
each large bucket. Rounds are the branchings on the way to the deepest large bucket.

Ids of the conversations that end at a node are joined in parts of 65,536 neighbouring ids at most, and the
parts are hashed as a stream, so no task holds the ids of a large group of copies.

Defined results: rows with a null conv_id take no part; null role and text are empty strings; turns go by
`turn`, null first, ties by role and then text; repeated rows are turns of their own; a conversation without
turns is a member of the root alone; columns other than conv_id, turn, role and text are ignored, whatever
their names; an empty table has no node, not even a root. One conversation's turn ids must fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Turns in a bucket that a task finishes by itself.
LOCAL = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, turn_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def encode(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The dictionary (turn_id, role, text, n_words), and (conv_id, seq, words) for each conversation.

    Only distinct turns are shuffled with their texts; conversations are put together by digests.
    """
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("digest")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).where("conv_id is not null")
    known = rows.select("role", "text").distinct().orderBy("role", "text")
    known = scratch.write(known.select(F.monotonically_increasing_id().alias("turn_id"), "role", "text", F.regexp_count("text", F.lit(WORD)).alias("n_words"), digest), "dictionary")
    coded = rows.select("conv_id", "turn", digest).join(known.select("digest", "turn_id", "n_words"), "digest")
    turn = F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "turn_id", "n_words")
    whole = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return known.drop("digest"), whole.select("conv_id", F.col("t.turn_id").alias("seq"), F.col("t.n_words").alias("words"))


def rebuild_with_shared_heads(sequences: DataFrame, scratch: Scratch) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 20, where h = crc32(c) % 4."""
    own = scratch.write(sequences, "own")
    heads = own.where("conv_id % 20 = 0").selectExpr("conv_id of", "slice(seq, 1, 3) head", "slice(words, 1, 3) head_words")
    both = own.withColumn("h", F.expr("cast(crc32(encode(string(conv_id), 'utf-8')) % 4 as int)")).join(heads, F.col("conv_id") - F.col("conv_id") % 20 == F.col("of"), "left")
    mixed = "concat(slice(coalesce({1}, cast(array() as array<{2}>)), 1, h), slice({0}, h + 1, greatest(size({0}) - h, 0))) {0}"
    return both.selectExpr("conv_id", mixed.format("seq", "head", "bigint"), mixed.format("words", "head_words", "int"))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes from their parts, which come in order: the ids are hashed part by part."""
    key, hashed, own = None, None, None
    for batch in batches:
        out = []
        for k, n, least, ids, seq, words in zip(*(batch.column(c) for c in ("key", "n", "least", "ids", "seq", "words")), strict=True):
            if (k := k.as_py()) != key:
                if key is not None:
                    out.append((*own, hashed.hexdigest()))
                key, hashed, own = k, hashlib.sha256(ids.as_py().encode()), [least.as_py(), n.as_py(), seq.as_py(), words.as_py()]
            else:
                hashed.update(b"," + ids.as_py().encode())
                own[1] += n.as_py()
        yield _classes(out)
    if key is not None:
        yield _classes([(*own, hashed.hexdigest())])


def _classes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["cls", "n", "seq", "words", "ends"])


def classes(sequences: DataFrame) -> DataFrame:
    """(cls, n, seq, words, ends): one row for each distinct sequence; cls is its smallest conv_id, ends the hash of all its ids."""
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("seq").cast("array<string>")).cast("binary"), 256))
    ids = F.concat_ws(",", F.array_sort(F.collect_list("conv_id")).cast("array<string>"))
    parts = sequences.groupBy(key.alias("key"), F.expr("conv_id div 65536").alias("part")).agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"), F.first("seq").alias("seq"), F.first("words").alias("words"))
    return parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_streamed, "cls bigint, n bigint, seq array<bigint>, words array<int>, ends string")


class Finisher:
    """Nodes of small buckets: multikey quicksort over turn ids, in which each part of equal ids is a child."""

    def __init__(self):
        self.rows: list[tuple] = []

    def bucket(self, members: list[tuple], at: int, parent: int | None, level: int, up: int) -> None:
        """members: (cls, n, seq, words, ends), alike in their first `at` turns, whose node is the bucket's top."""
        nodes: list[list] = []  # conv_id, depth, n_convs, children, leaves, saved, ends, place of the parent, turn id
        work = [(True, members, at, -1)]
        while work:
            whole, part, k, above = work.pop()
            if whole:  # a node of depth k, then its members beyond it
                while True:
                    n = sum(m[1] for m in part)
                    least = min(m[0] for m in part)
                    one = part[0]
                    ends = next((m[4] for m in part if len(m[2]) == k), NO_ENDS)
                    nodes.append([least, k, n, 0, 0, (n - 1) * one[3][k - 1] if k else 0, ends, above, one[2][k - 1] if k else None])
                    if above >= 0:
                        nodes[above][3] += 1
                    above = len(nodes) - 1
                    if len(part) > 1 or len(one[2]) == k:
                        break
                    k += 1
                part = [m for m in part if len(m[2]) > k]
                if part:
                    work.append((False, part, k, above))
            else:  # three parts by the turn id at place k
                pivot = part[len(part) // 2][2][k]
                for less in ([m for m in part if m[2][k] < pivot], [m for m in part if m[2][k] > pivot]):
                    if less:
                        work.append((False, less, k, above))
                work.append((True, [m for m in part if m[2][k] == pivot], k + 1, above))
        for node in reversed(nodes):  # parents come before their children
            node[4] = node[4] or 1
            if node[7] >= 0:
                nodes[node[7]][4] += node[4]
                nodes[node[7]][5] += node[5]
        for i, (least, depth, n, children, leaves, saved, ends, above, turn) in enumerate(nodes):
            self.rows.append((least, depth, nodes[above][0] if i else parent, turn, n, children, leaves, saved, ends, None if i else level, None if i else up))

    def flush(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.string(), pa.int32(), pa.int64()]
        names = ["conv_id", "depth", "parent_conv_id", "turn_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "level", "up"]
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], kind) for k, kind in enumerate(kinds)], names)
        self.rows = []
        return out


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket."""
    finisher, key, members, top = Finisher(), None, [], ()
    for batch in batches:
        for level, up, t, at, parent, *member in zip(*(batch.column(c).to_pylist() for c in ("level", "up", "t", "at", "parent", "cls", "n", "seq", "words", "ends")), strict=True):
            if (level, up, t) != key:
                if members:
                    finisher.bucket(members, *top)
                key, members, top = (level, up, t), [], (at, parent, level, up)
            members.append(tuple(member))
            if len(finisher.rows) > 50_000:
                yield finisher.flush()
    if members:
        finisher.bucket(members, *top)
    yield finisher.flush()


def trie(sequences: DataFrame, scratch: Scratch, local: int = LOCAL) -> DataFrame:
    """The nodes of the trie over (conv_id, seq, words), one row each."""
    rows = scratch.write(classes(sequences), "rows-0").selectExpr("cast(null as bigint) up", "cast(null as bigint) t", "0 at", "cast(null as bigint) parent", "*")
    large: list[DataFrame] = []  # of each round: the buckets dealt out, one row each
    ended: list[DataFrame] = []  # of each round: (bucket, ends) of sequences that end where a bucket branches
    small: list[DataFrame] = []
    level = 0
    while True:
        ends_of = F.min(F.struct("seq", "words"))
        stats = rows.groupBy("up", "t", "at", "parent").agg(
            F.count("*").alias("m"), F.sum(F.size("seq") - F.col("at")).alias("turns"), F.sum("n").alias("total"), F.min("cls").alias("bucket"), ends_of.alias("low"), F.max("seq").alias("high")
        )
        differ = F.expr("array_min(filter(sequence(0, size(low.seq)), i -> i = size(low.seq) or get(low.seq, i) <> get(high, i)))")  # an end before the other counts as a difference
        stats = stats.where(f"m > 1 and turns > {local}").withColumn("branch", differ).selectExpr(
            "up", "t", "at", "parent", "total", "bucket", "branch", "slice(low.seq, greatest(at, 1), branch - greatest(at, 1) + 1) ids", "slice(low.words, greatest(at, 1), branch - greatest(at, 1) + 1) words"
        )
        big = scratch.write(stats, f"big-{level}")
        some = big.limit(1).count()
        if not some:
            small.append(rows.withColumn("level", F.lit(level)))
            break
        key = big.selectExpr("up big_up", "t big_t", "bucket", "branch")
        mine = F.col("up").eqNullSafe(F.col("big_up")) & F.col("t").eqNullSafe(F.col("big_t"))
        small.append(rows.join(key, mine, "left_anti").withColumn("level", F.lit(level)))
        dealt = rows.join(key, mine).drop("up", "t", "at", "parent", "big_up", "big_t")
        ended.append(scratch.write(dealt.where("size(seq) = branch").select("bucket", "ends"), f"ended-{level}"))
        level += 1
        rows = scratch.write(dealt.where("size(seq) > branch").selectExpr("bucket up", "get(seq, branch) t", "branch + 1 at", "bucket parent", "cls", "n", "seq", "words", "ends"), f"rows-{level}")
        large.append(big)
    together = small[0]
    for more in small[1:]:
        together = together.unionByName(more)
    finished = together.repartition("level", "up", "t").sortWithinPartitions("level", "up", "t").mapInArrow(_finished, f"{NODES}, level int, up bigint")
    finished = scratch.write(finished, "finished")
    tops = finished.where("level is not null").select("level", "up", "n_leaves", "saved_tokens")
    nodes = finished.drop("level", "up")
    for k in range(level - 1, -1, -1):  # subtrees' totals, from the last round up
        below = tops.where(F.col("level") == k + 1).groupBy(F.col("up").alias("bucket")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
        full = large[k].join(below, "bucket").join(ended[k], "bucket", "left")
        # The depths from the bucket's own to where it branches, with what each and those under it save.
        deep = full.select("*", F.explode(F.sequence("at", "branch")).alias("depth"))
        place = F.col("depth") - F.greatest(F.col("at"), F.lit(1)) + 1
        under = F.aggregate(F.slice("words", F.greatest(place, F.lit(1)), F.size("words")), F.lit(0).cast("long"), lambda a, w: a + w)
        chain = deep.select(
            F.col("bucket").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("at"), F.col("bucket")).otherwise(F.col("parent")).alias("parent_conv_id"),
            F.when(F.col("depth") > 0, F.get("ids", place - 1)).alias("turn_id"), F.col("total").alias("n_convs"), F.when(F.col("depth") == F.col("branch"), F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            "n_leaves", (F.col("saved") + (F.col("total") - 1) * under).alias("saved_tokens"), F.when(F.col("depth") == F.col("branch"), F.coalesce("ends", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"), "at", "up",
        )
        chain = scratch.write(chain, f"chain-{k}")
        nodes = nodes.unionByName(chain.drop("at", "up"))
        tops = tops.unionByName(chain.where("depth = at").select(F.lit(k).alias("level"), "up", "n_leaves", "saved_tokens"))
    return nodes


#: DuckDB's form of op11 over the view conversations: every prefix of every rebuilt conversation, grouped.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id AS c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS s FROM t GROUP BY conv_id
), crc AS (
  SELECT c, s, xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_prepend(ord(x)::UBIGINT, list_resize([]::UBIGINT[], 8, 1000::UBIGINT))))),
    lambda a, b: CASE WHEN b = 1000 THEN xor(a >> 1, 3988292384::UBIGINT * (a & 1)) ELSE xor(a, b) END), 4294967295::UBIGINT) % 4 AS h FROM own
), w AS (
  SELECT crc.c, list_concat(coalesce(b.s[1:crc.h::BIGINT], []), crc.s[crc.h::BIGINT + 1:]) AS s FROM crc LEFT JOIN own b ON b.c = crc.c - crc.c % 20
), p AS (
  SELECT c, len(s) AS n, d, s[1:d] AS p FROM w, range(0, len(s) + 1) x(d)
), n AS (
  SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
    CASE WHEN any_value(d) = 0 THEN 0 ELSE len(regexp_extract_all(p[any_value(d)].t, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY p
), k AS (
  SELECT p[1:depth - 1] AS above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above
), f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.above = n.p
), u AS (
  SELECT f.p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM f, range(0, f.depth + 1) x(d) GROUP BY 1
)
SELECT f.conv_id, f.depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN u ON u.p = f.p LEFT JOIN n a ON f.depth > 0 AND a.p = f.p[1:f.depth - 1]
"""
