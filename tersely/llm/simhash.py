"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts.  A tile holds
fingerprints whose four 16-bit quarters have the same bit counts.  Two fingerprints within ``RADIUS`` bits have
quarter counts whose absolute differences sum to at most ``RADIUS``, so a tile meets only the tiles that near it and
every other pair of tiles is skipped without loss.  Equal fingerprints are one row throughout, and a tile pair returns
a spanning forest of its links, so a group of copies never becomes all its pairs.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and links like any other; a
text with one or two words hashes its whole word sequence once; repeated rows keep one result row each; null ids are larger than
all others, so a component of null ids only has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm.common import cut, fresh, partitions, raw, table, whole_groups
from tersely.llm.components import components

RADIUS = 2
#: Fingerprints of a tile; a cell with more is dealt over several tiles.
TILE = 2048


def fingerprint(text: bytes, width: int = 3) -> np.uint64:
    """The bits set in over half the XXH64 values (seed 42) of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.uint64(0)
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    stops = ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, n, 65536):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).view(">u8")[0]


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x) for x in batch.column("raw").to_pylist()], dtype=np.uint64)
        yield batch.drop_columns("raw").append_column("fp", pa.array(values.view(np.int64)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, h, g`` for every row: ``fp`` is a long with the 64 bits, ``h`` and ``g`` name the id and the text together."""
    doc, text = F.col(id_col).cast("long"), raw(text_col)
    rows = docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("h"), F.xxhash64(text, doc).alias("g"), text.alias("raw"))
    return rows.mapInArrow(_fingerprints, "doc_id long, h long, g long, fp long").select("doc_id", "fp", "h", "g")


def _forest(pairs: np.ndarray, up: dict[int, int]) -> list[tuple[int, int]]:
    """The pairs that join two trees of ``up``."""
    kept = []
    for a, b in pairs.tolist():
        x, y = a, b
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        while (p := up.setdefault(y, y)) != y:
            up[y] = y = up[p]
        if x != y:
            up[x] = y
            kept.append((a, b))
    return kept


def _tiles(batches: Iterable[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    for frame in whole_groups(batches, "tile", at_least=20_000):
        tiles, fps, home = (frame[c].to_numpy() for c in ("tile", "fp", "home"))
        cuts = np.flatnonzero(np.diff(tiles)) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(tiles)]))):
            part, own = fps[a:b], home[a:b]
            here, there = part[own], part[~own]
            up: dict[int, int] = {}
            for k in range(0, len(there), 512):
                block = there[k : k + 512]
                i, j = np.nonzero(np.bitwise_count((block[:, None] ^ here[None, :]).view(np.uint64)) <= radius)
                if len(i):
                    pairs = np.stack((block[i], here[j]), axis=1)
                    out += _forest(pairs[pairs[:, 0] != pairs[:, 1]], up)
        if out:
            a, b = np.array(out, dtype=np.int64).T
            yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints of ``fps(fp)`` that connect all that lie within ``radius`` bits."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))) for s in (48, 32, 16, 0)]
    cells = fps.select("fp", F.array(*quarters).alias("p"))
    number = lambda p: p[0] * 4913 + p[1] * 289 + p[2] * 17 + p[3]
    # of two neighbouring cells the one with the smaller offset visits, so each pair of tiles meets once
    near = sorted(o for o in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius and o >= (0, 0, 0, 0))
    # at most 17**4 rows, whatever the input
    sizes = F.broadcast(cells.groupBy(number(F.col("p")).alias("cell")).agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")))
    home = cells.select(number(F.col("p")).alias("cell"), "fp").join(sizes, "cell").select(F.col("cell").alias("c"), F.expr("cast(pmod(xxhash64(fp), tiles) as int)").alias("t"), "fp", F.lit(True).alias("home"))
    moves = F.array(*[F.array(*[F.lit(x) for x in o]) for o in near])
    shifted = cells.select("fp", "p", F.explode(moves).alias("o")).select("fp", *[(F.col("p")[i] + F.col("o")[i]).alias(f"q{i}") for i in range(4)])
    inside = shifted.where(" and ".join(f"q{i} between 0 and 16" for i in range(4))).select("fp", F.expr("q0 * 4913 + q1 * 289 + q2 * 17 + q3").alias("cell"))
    visit = inside.join(sizes, "cell").select(F.col("cell").alias("c"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("t"), "fp", F.lit(False).alias("home"))
    meet = home.unionByName(visit).select((F.col("c").cast("long") * (1 << 31) + F.col("t")).alias("tile"), "fp", "home")
    dealt = meet.repartition(partitions(fps), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(lambda b: _tiles(b, radius), "a long, b long")


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, first`` for each fingerprint of ``fingerprints``: the row of its component with the smallest id, nulls last."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g")
    heads = cut(marked.groupBy("fp").agg(F.min(row).alias("head")))
    # links are followed between fingerprints, so a row without an id still joins those on either side of it
    roots = components(links(heads.select("fp"), radius).select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = heads.join(roots, heads["fp"] == roots["node"], "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    return cut(members.join(members.groupBy("root").agg(F.min("head").alias("first")), "root").select("fp", "first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; component_id is the smallest doc_id reachable over links."""
    marked = cut(fingerprints(docs, id_col, text_col))
    return marked.join(classes(marked, radius), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: the one with the smallest doc_id, null ids last; of equal ids any single one.

    Rows are told apart by 128 bits of hashes of id and text, so rows with a null or a repeated id are judged one by one, and
    of rows that agree in both one stays; the columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    h, g = fresh(docs, "_h", "_g")
    kept = classes(cut(fingerprints(docs))).select(F.col("first.h").alias(h), F.col("first.g").alias(g)).distinct()
    doc, text = F.col("doc_id").cast("long"), raw("text")
    rows = docs.withColumns({h: F.xxhash64(doc, text), g: F.xxhash64(text, doc)}).dropDuplicates([h, g])
    return rows.join(kept, [h, g], "left_semi").select(*docs.columns)
