"""Operator 4: exact self-join of documents on the Jaccard similarity of word shingles.

Two documents link when ``100 * intersection >= percent * union``.  Texts with the same
set form a class first, so copies never meet each other.  Each class has a prefix of
its set under one global order (the rarest shingles first), long enough that two
classes that link share a shingle of their prefixes.  All classes with one prefix
shingle in common have a leader, the one of the least hash.  A *tile* holds the classes
that have one leader, in bands of size; only equal and neighbouring bands can link.  Two
classes that share a shingle share its leader, so they meet in a tile, and near copies
that share very many shingles still meet in few.  Tiles are split into blocks of about
TILE classes, and block meets block, so no task holds a whole large tile.

Round 1 ties each class to at most two of its leaders and to the TIES classes before it
in its blocks.  Large groups of near copies merge here with a few links for each class.
Round 2 meets, in tiles that still hold several components, the classes outside a
tile's largest component with all others of another component.  The likeliest partner
of each class is verified first; then those pairs that are still in different
components.
In either round a pair must first pass its signatures: the parity bitmap of a set has a
bit for each of 1536 hash values, and ``popcount(a xor b)`` is at most the size of the
symmetric difference, which bounds the overlap from above.  Such bitmaps fill up with
some thousands of shingles, so large sets have one in proportion to their size too,
which pairs must pass as well.  What is left is verified by intersecting the sets themselves, which are made again for the texts that need it.  So
no link between different components is missed, and pairs within a component are not
enumerated.

Shingles and classes are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphtables.llm.common import Scratch, slices, table
from graphtables.llm.components import components
from graphtables.llm.shingle_sets import PIECE, all_blocks, apart, block, blocks_of, long_may_link, long_signatures, may_link, pieces_of, sets_of_nodes, shingles_sql, signatures, signed_classes, tiles_of, verified, whole_texts, word_rarity

WORDS = 24
TIES = 4
SIGNATURE = [f"s{k}" for k in range(WORDS)]


def classes(texts: DataFrame, steps: np.ndarray, width: int, percent: int) -> DataFrame:
    """Each row's class: doc_id, h, node, n; and, where a task meets a class first, its prefix and signature."""
    shared = texts.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, steps = set(), shared.value
        for piece in slices(batches, "text", PIECE):
            for at_rows, sets in pieces_of(whole_texts(piece.column("text").to_pylist()), width, steps):
                new = []
                for i, node in enumerate(sets.nodes.tolist()):
                    if node and node not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(node)
                        new.append(i)
                at, n = np.array(new, np.int64), sets.sizes
                old = np.ones(len(n), bool)
                old[at] = False
                prefix = sets.prefixes(at, percent)
                sig = signatures(sets, WORDS)
                yield pa.record_batch([piece.column("doc_id")[at_rows], piece.column("h")[at_rows], pa.array(sets.nodes), pa.array(n), prefix, long_signatures(sets, at), *(pa.array(sig[:, k], mask=old) for k in range(WORDS))], ["doc_id", "h", "node", "n", "prefix", "long", *SIGNATURE])

    return texts.mapInArrow(run, "doc_id long, h long, node long, n long, prefix binary, long array<long>, " + ", ".join(f"{s} long" for s in SIGNATURE))


def near_duplicates(spark: SparkSession, df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``df``.

    Null, empty and blank texts have no shingles and are their own component.  A text
    of fewer than ``width`` words is one shingle.  Rows that repeat an id are kept
    apart by their texts; component_id is the smallest id that is not null, and null if
    there is none.  Other columns are not read.
    """
    texts = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[id_col].cast("long"), df[text_col].cast("string")).alias("h"), df[text_col].cast("string").cast("binary").alias("text"))
    similar = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    band = F.floor(F.ln(F.col("n")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int").alias("band")
    with Scratch(spark) as tmp:
        steps = word_rarity(texts, 20)
        rows = tmp.table(classes(texts, steps, width, percent), "classes")
        tiles = tiles_of(tmp, rows).select("leader", "node", "n")
        signed = signed_classes(tmp, rows, tiles, SIGNATURE)
        sizes = tmp.table(blocks_of(tiles), "sizes")
        sides = [signed.select(F.col("node").alias(c), *(F.col(s).alias(c + s) for s in SIGNATURE)) for c in "ab"]
        bits = [[F.col(c + s) for s in SIGNATURE] for c in "ab"]
        longs = [rows.filter("long is not null").select(F.col("node").alias(c), F.col("long").alias("l" + c)).dropDuplicates([c]) for c in "ab"]

        def hopeful(pairs: DataFrame) -> DataFrame:
            """Those of ``pairs`` whose long signatures allow a link; all where one has none."""
            both = pairs.join(longs[0], "a", "left").join(longs[1], "b", "left")
            return both.filter(long_may_link(F.col("la"), F.col("lb"), F.col("na"), F.col("nb"), percent)).select(pairs.columns)

        def sets_for(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
            nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            return sets_of_nodes(tmp, texts, signed.select("node", "h").join(nodes, "node"), whole_texts, steps, width)

        def links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
            return tmp.table(verified(pairs, sets, percent).toDF("u", "v"), "links")

        # Round 1.
        place = W.partitionBy("leader", "block").orderBy("n", "node")
        lags = [f"before{k}" for k in range(1, TIES + 1)]
        held = tiles.join(sizes, "leader").select("leader", "node", "n", block())
        ties = held.select("leader", "node", "n", *(F.lag(F.struct("n", "node"), k).over(place).alias(b) for k, b in enumerate(lags, 1)))
        led = tiles.filter("leader = node").select("leader", F.struct("n", "node").alias("lead"))
        ties = ties.join(led, "leader").withColumn("lead", F.when(F.col("leader") != F.col("node"), F.col("lead")))
        ties = ties.groupBy("node", "n").agg(F.array(F.min("lead"), F.max("lead"), *(F.min(b) for b in lags)).alias("to"))
        pairs = ties.select("node", "n", F.explode(F.array_distinct(F.array_compact("to"))).alias("to")).select(F.col("to.node").alias("a"), F.col("to.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")).filter(similar)
        pairs = pairs.join(sides[0], "a").join(sides[1], "b").filter(may_link(*bits, F.col("na"), F.col("nb"), percent)).select("a", "na", "b", "nb")
        pairs = tmp.table(hopeful(pairs), "pairs")
        sets, used = sets_for(pairs)
        links = links_of(pairs, sets)
        tmp.free(*used)
        comp = tmp.table(components(tmp, links), "components")

        # Round 2: tiles that still hold more than one component.
        placed = tiles.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        shares = placed.groupBy("leader", "comp").agg(F.count(F.lit(1)).alias("held"))
        mixed = shares.groupBy("leader").agg(F.max(F.struct("held", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        mixed = tmp.table(mixed.join(sizes, "leader").select("leader", F.col("main.comp").alias("main"), "blocks"), "mixed")
        open_ = tmp.table(placed.join(mixed, "leader").join(signed.drop("h"), "node").withColumn("band", band), "open")
        a = open_.filter("comp <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
        a = a.select("leader", "band", all_blocks(), "main", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), *(F.col(s).alias(f"a{s}") for s in SIGNATURE))
        b = open_.select("leader", "band", block(), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), *(F.col(s).alias(f"b{s}") for s in SIGNATURE))
        # Of two classes outside the main component, the smaller hash is a.
        meet = (a["leader"] == b["leader"]) & (a["band"] == b["band"]) & (a["block"] == b["block"]) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
        meet = meet & F.expr(similar) & may_link(*bits, F.col("na"), F.col("nb"), percent)
        rest = a.join(b, meet).select("a", "na", "ca", "b", "nb", "cb", apart(*bits).alias("apart")).distinct()
        tried = pairs.select("a", "b").union(pairs.select("b", "a"))
        rest = tmp.table(hopeful(rest.join(tried, ["a", "b"], "left_anti").select(rest.columns)), "rest")
        tmp.free(open_)
        if not rest.isEmpty():
            sets, used = sets_for(rest)
            likely = rest.groupBy("a", "na").agg(F.min(F.struct((F.col("apart") / (F.col("na") + F.col("nb"))).alias("apart"), "b", "nb")).alias("to"))
            likely = tmp.table(likely.select("a", "na", F.col("to.b").alias("b"), F.col("to.nb").alias("nb")), "likely")
            links = links.union(links_of(likely, sets))
            comp = tmp.table(components(tmp, links), "components")
            now = [comp.select(F.col("node").alias(c), F.col("comp").alias("now" + c)) for c in "ab"]
            open_pairs = rest.join(likely.select("a", "b"), ["a", "b"], "left_anti").join(now[0], "a", "left").join(now[1], "b", "left")
            open_pairs = tmp.table(open_pairs.filter(F.coalesce("nowa", "ca") != F.coalesce("nowb", "cb")).select("a", "na", "b", "nb"), "pairs")
            if not open_pairs.isEmpty():
                comp = tmp.table(components(tmp, links.union(links_of(open_pairs, sets))), "components")
            tmp.free(*used)

        # A class's component is named by the smallest id of its rows.
        full = rows.filter("n > 0")
        least = full.groupBy("node").agg(F.min("doc_id").alias("least")).join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = least.groupBy("comp").agg(F.min("least").alias("component_id"))
        by_node = least.select("node", "comp").join(named, "comp").select("node", "component_id")
        out = full.join(by_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        empty = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return tmp.keep(out.union(empty))


def one_of_each(spark: SparkSession, df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, that are not linked to one of a smaller id.

    Rows without an id or without shingles stay.  Of rows that repeat both id and text
    one stays, if there are any such in a component.
    """
    marks = near_duplicates(spark, df, width, percent, id_col, text_col).filter("n_shingles > 0 and doc_id is not null")
    gone = marks.filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = df.join(gone, df[id_col].cast("long") == gone["__id"], "left_anti")
    again = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__id")
    if again.isEmpty():
        return kept
    on = kept[id_col].cast("long") == again["__id"]
    return kept.join(again, on, "left_anti").union(kept.join(again, on, "left_semi").dropDuplicates([id_col, text_col]))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH RECURSIVE s AS (SELECT DISTINCT doc_id, g FROM ({shingles_sql("doc_id", "documents")})),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
     reach(doc_id, other) AS (SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
