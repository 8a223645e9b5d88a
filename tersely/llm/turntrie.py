"""Prefix trie of conversations by polynomial rolling fingerprints.

Turns are sorted over all tasks by ranges, so a long conversation is spread over several, and numpy scans each task's rows: the
prefix of ``d`` turns has the fingerprint ``sum(hash(turn i) * B**i) mod P`` for four bases ``B``.  The sums of the rows before a task's
first one are added afterwards, from one row a task.  As the fingerprint is a sum, that of a rebuilt conversation (a prefix of another
one, then its own later turns) is worked out from the sums of the two.

Prefixes of one depth and fingerprint are a group.  Each group is verified turn by turn: all its last turns must be equal, so by
induction over the depth all its turns are.  A group with unlike turns is a collision; its turns are numbered, the numbers go into
the keys of all prefixes that hold them, and the groups are made anew until all hold.  A prefix that many conversations take from one
is counted, not repeated.

Then the nodes are rolled up.  A node's conversation is its smallest member, and the nodes of one conversation are a path.  A path hangs
on the node of another; totals go up from path to path, one round a level of paths.  Nodes with one member need no sums.

Defined results: a null role or text is empty, null turns come first, rows of one turn go by role, then text; rows without a
conversation id belong to none and take no part; an empty table gives an empty result; conversations
that are turnless once rebuilt are members of the root; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tersely.llm.common import cut, partitions, table

#: The fingerprint's modulus, a prime, and its bases.
MODULUS = (1 << 31) - 1
BASES = (1_103_515_245, 214_013_531, 69_069_069, 1_664_525_013)
#: A conversation takes up to so many turns from the first one of its hundred.
MOST = 5


def powers(base: int, n: int, modulus: int) -> np.ndarray:
    """``base ** i`` for i from 0 to n - 1."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * pow(base, len(out), modulus) % modulus))
    return out[:n]


def _scan(batches: Iterable[pa.RecordBatch], modulus: int = MODULUS) -> Iterator[pa.RecordBatch]:
    """Place of each row in its conversation, the fingerprint with it (``s``) and without it (``p``), as far as this task's rows tell."""
    task = TaskContext.get()
    conv, count, sums = None, 0, [0] * len(BASES)
    for batch in batches:
        c = batch.column("c").to_numpy()
        n = len(c)
        if not n:
            continue
        heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n))) + 1
        goes_on = np.arange(n) < (heads[1] if len(heads) > 1 else n) if c[0] == conv else np.zeros(n, bool)
        values = [x.to_numpy().view(np.uint64) >> np.uint64(s) for x in (batch.column("h1"), batch.column("h2")) for s in (0, 32)]
        out = {}
        for j, (base, v) in enumerate(zip(BASES, values)):
            x = (v & np.uint64(0xFFFFFFFF)).astype(np.int64) % modulus * powers(base, n + 1, modulus)[place] % modulus
            run = np.cumsum(x)
            s = (run - np.repeat((run - x)[heads], np.diff(np.append(heads, n)))) % modulus
            p = (s - x) % modulus
            if goes_on.any():
                shift = pow(base, count, modulus)
                s, p = (np.where(goes_on, (sums[j] + y * shift) % modulus, y) for y in (s, p))
            out[f"s{j}"], out[f"p{j}"], sums[j] = s, p, int(s[-1])
        place = np.where(goes_on, place + count, place)
        conv, count = c[-1], int(place[-1])
        columns = {k: batch.column(k) for k in ("c", "role", "text")}
        columns |= {"pos": pa.array(place, pa.int64()), "task": pa.array(np.full(n, task.partitionId() if task else 0, np.int32))}
        yield pa.record_batch(columns | {k: pa.array(v) for k, v in sorted(out.items())})


def _carried(rows: DataFrame, modulus: int) -> dict[int, tuple[int, int, list[int]]]:
    """For a task whose first conversation goes on from earlier ones: that conversation, its rows there and their sums."""
    tracks = range(len(BASES))
    ends = rows.groupBy("task").agg(F.min("c").alias("first"), F.max(F.struct("c", "pos", *[f"s{j}" for j in tracks])).alias("last"))
    out, conv, count, sums = {}, None, 0, [0] * len(BASES)
    for r in sorted(ends.collect()):  # one row a task
        last, own = r["last"], [r["last"][f"s{j}"] for j in tracks]
        if r["first"] == conv:
            out[r["task"]] = (conv, count, list(sums))
        if last["c"] == conv:
            sums = [(sums[j] + own[j] * pow(BASES[j], count, modulus)) % modulus for j in tracks]
            count += last["pos"]
        else:
            conv, count, sums = last["c"], last["pos"], own
    return out


def scanned(turns: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """``c, pos, role, text, s0.., p0..``: each turn's place in its conversation, from 1, and the fingerprints with and without it."""
    given = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text")).where("c is not null")
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    hashed = rows.repartitionByRange(partitions(turns), *order).sortWithinPartitions(*order).select("c", "role", "text", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", "role", F.lit(1)).alias("h2"))
    tracks = range(len(BASES))
    schema = "c long, role string, text string, pos long, task int, " + ", ".join(f"{k}{j} long" for k in "ps" for j in tracks)
    found = cut(hashed.mapInArrow(lambda b: _scan(b, modulus), schema))
    carried = _carried(found, modulus)
    if not carried:
        return found.drop("task")
    rows = [(t, c, n, *sums, *[pow(b, n, modulus) for b in BASES]) for t, (c, n, sums) in carried.items()]
    before = turns.sparkSession.createDataFrame(rows, "task int, bc long, bn long, " + ", ".join(f"{k}{j} long" for k in ("bs", "bp") for j in tracks))
    goes_on = F.col("c") == F.coalesce("bc", F.col("c") - 1)
    moved = {f"{k}{j}": F.when(goes_on, (F.col(f"bs{j}") + F.col(f"{k}{j}") * F.col(f"bp{j}")) % modulus).otherwise(F.col(f"{k}{j}")) for k in "sp" for j in tracks}
    joined = found.join(F.broadcast(before), "task", "left").withColumns({"pos": F.when(goes_on, F.col("pos") + F.col("bn")).otherwise(F.col("pos")), **moved})
    return joined.select("c", "pos", "role", "text", *moved)


def _packed(values: list[Column], name: str) -> list[Column]:
    return [(values[i] * (1 << 31) + values[i + 1]).alias(f"{name}{i // 2}") for i in (0, 2)]


def rebuilt(rows: DataFrame, modulus: int = MODULUS) -> tuple[DataFrame, DataFrame]:
    """The prefixes of the rebuilt conversations and the conversations themselves, from ``scanned`` rows.

    ``prefixes``: ``head, owner, conv_id, n, depth, f0, f1, p0, p1, role, text``; of a head, ``n`` conversations take it from ``owner`` and
    ``conv_id`` is the smallest.  ``convs``: ``conv_id, base, k, depth, f0, f1``, with ``k`` turns from ``base``.
    """
    tracks = range(len(BASES))
    sums = lambda k: F.array(*[F.col(f"{k}{j}") for j in tracks])
    # the first few sums of a conversation, and its last
    own = rows.groupBy("c").agg(F.max(F.struct("pos", sums("s").alias("s"))).alias("end"), F.sort_array(F.collect_list(F.when(F.col("pos") <= MOST, F.struct("pos", sums("s").alias("s"))))).alias("heads"))
    zero = F.array(*[F.lit(0).cast("long") for _ in tracks])
    own = own.withColumn("sums", F.concat(F.array(zero), F.transform("heads", lambda x: x["s"]))).select("c", F.col("end.pos").alias("len"), F.col("end.s").alias("end"), "sums")
    own = own.withColumns({"h": (F.crc32(F.col("c").cast("string").cast("binary")) % (MOST + 1)).cast("int"), "base": F.col("c") - F.col("c") % 100})
    bases = own.where("c % 100 = 0").select(F.col("c").alias("base"), F.col("sums").alias("base_sums"))
    k = F.least("h", F.coalesce(F.size("base_sums") - 1, F.lit(0)))
    plan = own.join(bases, "base", "left").withColumn("k", k)
    plan = plan.select("c", "base", "h", "k", "len", "end", F.coalesce(F.get("base_sums", "k"), zero).alias("start"), F.coalesce(F.get("sums", "h"), zero).alias("skipped"))
    plan = cut(plan)
    back = [F.array(*[F.lit(pow(b, -i, modulus)) for i in range(MOST + 1)]) for b in BASES]
    moved = lambda value, j: (F.get("start", F.lit(j)) + F.pmod(value - F.get("skipped", F.lit(j)), F.lit(modulus)) * F.get(back[j], F.col("h") - F.col("k"))) % modulus
    longer = F.col("len") > F.col("h")
    ends = [F.when(longer, moved(F.get("end", F.lit(j)), j)).otherwise(F.get("start", F.lit(j))) for j in tracks]
    convs = plan.select(F.col("c").alias("conv_id"), "base", "k", (F.col("k") + F.greatest(F.col("len") - F.col("h"), F.lit(0))).cast("long").alias("depth"), *_packed(ends, "f"))
    later = rows.join(plan.select("c", "h", "k", "start", "skipped"), "c").where("pos > h")
    later = later.select(F.lit(False).alias("head"), F.col("c").alias("owner"), F.col("c").alias("conv_id"), F.lit(1).cast("long").alias("n"), (F.col("pos") - F.col("h") + F.col("k")).cast("long").alias("depth"), *_packed([moved(F.col(f"s{j}"), j) for j in tracks], "f"), *_packed([moved(F.col(f"p{j}"), j) for j in tracks], "p"), "role", "text")
    # how many conversations take at least so many turns from a base, and the smallest of them
    depth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("k").cast("long"))).alias("pos")
    takers = plan.where("k > 0").select(F.col("base").alias("c"), "c", depth).toDF("c", "taker", "pos").groupBy("c", "pos").agg(F.min("taker").alias("conv_id"), F.count("*").alias("n"))
    heads = rows.where((F.col("c") % 100 == 0) & (F.col("pos") <= MOST)).join(takers, ["c", "pos"])
    heads = heads.select(F.lit(True).alias("head"), F.col("c").alias("owner"), "conv_id", "n", F.col("pos").alias("depth"), *_packed([F.col(f"s{j}") for j in tracks], "f"), *_packed([F.col(f"p{j}") for j in tracks], "p"), "role", "text")
    return later.unionByName(heads), convs


KEY = ("depth", "f0", "f1", "tag")


def _tagged(prefixes: DataFrame, convs: DataFrame, splits: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Prefixes and conversations with ``tag`` and ``ptag``: the numbers of the turns that collisions split, up to a depth and the one before it."""
    if splits is None:
        none = F.lit("")
        return prefixes.withColumns({"tag": none, "ptag": none}), convs.withColumn("tag", none)
    listed = splits.groupBy("head", "owner").agg(F.sort_array(F.collect_list(F.struct("depth", "split"))).alias("list"))
    of_heads = listed.where("head").select(F.col("owner").alias("base"), F.col("list").alias("base_list"))
    of_convs = listed.where("not head").select(F.col("owner").alias("conv_id"), F.col("list").alias("own_list"))
    empty = F.array().cast("array<struct<depth:bigint,split:int>>")
    known = lambda c: F.coalesce(c, empty)
    both = F.concat(F.filter(known("base_list"), lambda x: x["depth"] <= F.col("k")), known("own_list"))
    convs = convs.join(of_heads, "base", "left").join(of_convs, "conv_id", "left").withColumn("list", both).drop("base_list", "own_list")
    lists = convs.select(F.lit(False).alias("head"), F.col("conv_id").alias("owner"), "list").unionByName(listed.where("head"))
    tag = lambda depth: F.array_join(F.transform(F.filter(known("list"), lambda x: x["depth"] <= depth), lambda x: F.concat_ws(":", x["depth"], x["split"])), ",")
    tagged = prefixes.join(lists, ["head", "owner"], "left").withColumns({"tag": tag(F.col("depth")), "ptag": tag(F.col("depth") - 1)})
    return tagged.drop("list"), convs.withColumn("tag", tag(F.col("depth"))).drop("list")


def grouped(prefixes: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified groups of prefixes, ``depth, f0, f1, tag, p0, p1, ptag, conv_id, n_convs, chars``, and the conversations with their keys."""
    turn, splits = F.struct("role", "text"), None
    while True:
        tagged, ends = _tagged(prefixes, convs, splits)
        groups = tagged.groupBy(*KEY).agg(F.min(F.struct("p0", "p1", "ptag")).alias("p"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(turn).alias("least"), F.max(turn).alias("most"))
        groups = cut(groups.select(*KEY, "p.*", "conv_id", "n_convs", F.char_length("most.text").alias("chars"), (F.col("least") == F.col("most")).alias("holds")))
        failed = groups.where("not holds").select(*KEY)
        if failed.isEmpty():
            return groups.drop("holds"), ends
        number = F.dense_rank().over(Window.partitionBy(*KEY).orderBy("role", "text")) - 1
        new = tagged.join(failed, list(KEY), "left_semi").select("head", "owner", "depth", number.alias("split"))
        splits = cut(new if splits is None else splits.unionByName(new))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, which come in order; a node may go on over many batches."""
    node, state = None, None
    for batch in batches:
        keys, ids = list(zip(*[batch.column(k).to_pylist() for k in KEY])), batch.column("conv_id").to_pylist()
        done = []
        for key, i in zip(keys, ids):
            if key == node:
                state.update(b",%d" % i)
                continue
            if state:
                done.append((*node, state.hexdigest()))
            node, state = key, hashlib.sha256(b"%d" % i)
        if done:
            yield _node_batch(done)
    if state:
        yield _node_batch([(*node, state.hexdigest())])


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [*KEY, "ends_sha256"])


def ended(convs: DataFrame) -> DataFrame:
    """``depth, f0, f1, tag, ends_sha256`` of nodes at which conversations end; a node's ids are read in order and never held together."""
    order = [*KEY, "conv_id"]
    dealt = convs.select(*order).repartition(partitions(convs), *KEY).sortWithinPartitions(*order)
    return dealt.mapInArrow(_digests, "depth long, f0 long, f1 long, tag string, ends_sha256 string")


def totals(shared: DataFrame) -> DataFrame:
    """``conv_id, depth, n_leaves, saved_tokens`` over the subtrees of ``shared(conv_id, depth, parent_conv_id, leaves, saved)``."""
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    paths = cut(shared.groupBy("conv_id").agg(F.min(F.struct("depth", "parent_conv_id")).alias("top"), *sums).select("conv_id", F.col("top.parent_conv_id").alias("up"), (F.col("top.depth") - 1).alias("at"), "leaves", "saved"))
    hung = paths.where("up is not null")
    flows = []
    while True:
        # what arrives at a node of another path; it goes on from there with that path
        flow = cut(hung.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(*sums))
        if flow.isEmpty():
            break
        flows.append(flow)
        hung = flow.groupBy("conv_id").agg(*sums).join(paths.where("up is not null").select("conv_id", "up", "at"), "conv_id")
    own = shared.select("conv_id", "depth", "leaves", "saved")
    whole = reduce(DataFrame.unionByName, flows, own).groupBy("conv_id", "depth").agg(*sums)
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    return whole.select("conv_id", "depth", F.sum("leaves").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("saved_tokens"))


def trie(turns: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """One row a node of the trie of ``turns(conv_id, turn, role, text)``'s rebuilt conversations."""
    groups, convs = grouped(*rebuilt(scanned(turns, modulus), modulus))
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = whole.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f0"), F.lit(0).cast("long").alias("f1"), F.lit("").alias("tag"), *[F.lit(None).cast(t).alias(k) for k, t in (("p0", "long"), ("p1", "long"), ("ptag", "string"))], "conv_id", "n_convs", F.lit(0).alias("chars"))
    nodes = groups.unionByName(root)
    up = [F.col(p).alias(k) for k, p in zip(KEY[1:], ("p0", "p1", "ptag"))]
    children = groups.select((F.col("depth") - 1).alias("depth"), *up, "n_convs").groupBy(*KEY).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    nodes = nodes.join(children, list(KEY), "left").join(ended(convs), list(KEY), "left").na.fill(0, ["n_children", "n_single"])
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(KEY[1:], ("p0", "p1", "ptag"))], F.col("conv_id").alias("parent_conv_id"))
    nodes = cut(nodes.join(parents, ["depth", "p0", "p1", "ptag"], "left").drop(*KEY[1:], "p0", "p1", "ptag"))
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")).cast("long")
    shared = nodes.where("n_convs > 1").select("conv_id", "depth", "parent_conv_id", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).cast("long").alias("saved"))
    found = nodes.join(totals(shared), ["conv_id", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


def trie_sql() -> str:
    """The same result in DuckDB's SQL: prefixes as lists, and each node's value given to all its prefixes."""
    return """
    WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    turns AS (SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(t ORDER BY pos) AS l, CAST(c AS VARCHAR) AS name FROM turns GROUP BY c),
    coded AS (SELECT c, l, xor(4294967295, list_reduce(list_concat([4294967295]::BIGINT[], list_transform(range(length(name)), lambda i: CAST(ascii(substr(name, i + 1, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]))) % 6 AS h FROM own, tab),
    rebuilt AS MATERIALIZED (SELECT a.c, list_concat(coalesce(b.l[:a.h], []), a.l[a.h + 1:]) AS l FROM coded a LEFT JOIN coded b ON b.c = a.c - a.c % 100),
    members AS MATERIALIZED (SELECT c, d AS depth, l[:d] AS prefix, len(l) = d AS ends FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
    nodes AS MATERIALIZED (SELECT depth, prefix, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY depth, prefix),
    named AS MATERIALIZED (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.prefix[-1].text) END AS saved FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[:n.depth - 1]),
    children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY ALL),
    whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM named n LEFT JOIN children USING (conv_id, depth)),
    below AS (SELECT prefix[:d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT prefix, n_children, saved, unnest(range(depth + 1)) AS d FROM whole) GROUP BY 1)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM whole JOIN below USING (prefix)"""
