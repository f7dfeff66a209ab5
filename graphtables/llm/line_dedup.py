"""Operator 10: lines that are near copies of earlier lines, by an exact set-similarity join.

Lines end at a line feed.  A line is the set of its five-word shingles (the whole line,
where it has fewer words), ordered by rarity as ``shingle_sets`` says.  Lines are
ordered by (doc_id, hash of id and text, line number), a null id first; a line goes if any
earlier line has ``100 * intersection >= percent * union`` with it, whether that one
stays or goes.  So the result depends on no order of execution.

Lines of the same set form a class, which its earliest line stands for.  Classes that
match share a shingle of their prefixes (prefix filter).  All classes with one prefix
shingle in common have a leader, the one of the least hash, and a *tile* holds the
classes of one leader, each with the first place at which it has a shingle of this
leader.  Two classes that match meet in the tile of their first common shingle, where no
more can be in common than follows those places (positional filter), if their sizes
allow it (length filter).  Parity bitmaps of the sets then bound the overlap from above,
and what is left is verified on the sets.  Tiles are split into blocks of about TILE
classes, and block meets block, so no task holds a whole large tile.

One earlier match is enough, so each class is first held against the earliest class of
its blocks and the TIES before it; only classes without a match then meet all earlier
ones of their tiles.  Shingles and classes are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphtables.llm.common import Scratch, slices, table
from graphtables.llm.shingle_sets import PIECE, all_blocks, block, blocks_of, lines, may_link, pieces_of, sets_of_nodes, shingles_sql, signatures, signed_classes, tiles_of, verified, word_rarity

WORDS = 4
TIES = 3
SIGNATURE = [f"s{k}" for k in range(WORDS)]


def _line_classes(texts: DataFrame, steps: np.ndarray, width: int, percent: int) -> DataFrame:
    """A row for each line with words: its key, its class and, where a task meets the class first, its prefix and signature."""
    shared = texts.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, steps = set(), shared.value
        for piece in slices(batches, "text", PIECE):
            rows = lines(piece.column("text").to_pylist())
            for at_rows, sets in pieces_of(rows, width, steps):
                new = []
                for i, node in enumerate(sets.nodes.tolist()):
                    if node not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(node)
                        new.append(i)
                at, n = np.array(new, np.int64), sets.sizes
                old = np.ones(len(n), bool)
                old[at] = False
                prefix = sets.prefixes(at, percent)
                sig = signatures(sets, WORDS)
                own = pa.array(rows.text[at_rows])
                yield pa.record_batch([piece.column("doc_id").take(own), piece.column("h").take(own), pa.array(rows.number[at_rows].astype(np.int32)), pa.array(sets.nodes), pa.array(n.astype(np.int32)), prefix, *(pa.array(sig[:, k], mask=old) for k in range(WORDS))], ["doc_id", "h", "line_no", "node", "n", "prefix", *SIGNATURE])

    return texts.mapInArrow(run, "doc_id long, h long, line_no int, node long, n int, prefix binary, " + ", ".join(f"{s} long" for s in SIGNATURE))


def late_lines(spark: SparkSession, df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (xxhash64 of id and text), line_no (from 0) and n_shingles of each line that matches an earlier one.

    Lines without words match nothing, and null and empty texts have none.  Rows that
    repeat both id and text are one document: the same lines go in each of them, and
    each gives its rows here.  Other columns are not read.
    """
    texts = df.select(df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[id_col].cast("long"), df[text_col].cast("string")).alias("h"), df[text_col].cast("string").cast("binary").alias("text"))
    similar = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    # Nothing in common comes before the places pa and pb.
    enough = f"(100 + {percent}) * least(na - pa, nb - pb) >= {percent} * (na + nb)"
    with Scratch(spark) as tmp:
        steps = word_rarity(texts)
        rows = tmp.table(_line_classes(texts, steps, width, percent), "lines")
        key = F.struct("doc_id", "h", "line_no")
        firsts = tmp.table(rows.groupBy("node").agg(F.min(key).alias("key"), F.count(F.lit(1)).alias("copies")), "firsts")
        found = tiles_of(tmp, rows)
        signed = signed_classes(tmp, rows, found, SIGNATURE)
        tiles = tmp.table(found.join(firsts.select("node", "key"), "node").join(tmp.table(blocks_of(found), "sizes"), "leader").select("leader", "node", "n", "pos", "key", "blocks"), "tiles")
        tmp.free(found)
        sides = [signed.select(F.col("node").alias(c), *(F.col(s).alias(c + s) for s in SIGNATURE)) for c in "ab"]
        alike = may_link(*([F.col(c + s) for s in SIGNATURE] for c in "ab"), F.col("na"), F.col("nb"), percent)

        def matched(pairs: DataFrame) -> DataFrame:
            """The later classes (node) of verified ``pairs`` (a, na, b, nb), b the earlier."""
            nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            sets, used = sets_of_nodes(tmp, texts, signed.select("node", "h").join(nodes, "node"), lines, steps, width)
            late = tmp.table(verified(pairs, sets, percent).select(F.col("a").alias("node")).distinct(), "late")
            tmp.free(*used)
            return late

        place = W.partitionBy("leader", "block").orderBy("key.doc_id", "key.h", "key.line_no")
        early = F.struct("key", "node", "n", "pos")
        ties = tiles.select("leader", "node", "n", "pos", "key", block())
        ties = ties.select("node", F.col("n").alias("na"), F.col("pos").alias("pa"), F.first(early).over(place).alias("b0"), *(F.lag(early, k).over(place).alias(f"b{k}") for k in range(1, TIES + 1)))
        hopeful = [F.when((F.col(f"b{k}.node") != F.col("node")) & F.expr(similar.replace("nb", f"b{k}.n")) & F.expr(enough.replace("nb", f"b{k}.n").replace("pb", f"b{k}.pos")), F.struct(f"b{k}.key", f"b{k}.node", f"b{k}.n")) for k in range(TIES + 1)]
        ties = ties.select("node", "na", *(h.alias(f"b{k}") for k, h in enumerate(hopeful))).filter(" or ".join(f"b{k} is not null" for k in range(TIES + 1)))
        # Of all tiles together, the earliest first ones and the latest of the others.
        some = ties.groupBy("node", "na").agg(F.array(F.min("b0"), *(F.max(f"b{k}") for k in range(1, TIES + 1))).alias("to"))
        some = some.select(F.col("node").alias("a"), "na", F.explode(F.array_distinct(F.array_compact("to"))).alias("to"))
        pairs = some.select("a", "na", F.col("to.node").alias("b"), F.col("to.n").alias("nb"))
        pairs = tmp.table(pairs.join(sides[0], "a").join(sides[1], "b").filter(alike).select("a", "na", "b", "nb"), "pairs")
        late = matched(pairs)

        # Classes without a match meet all earlier ones.
        held = tiles.join(signed.drop("h"), "node")
        a = held.join(late, "node", "left_anti").select("leader", all_blocks(), F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("key").alias("ka"), *(F.col(s).alias("a" + s) for s in SIGNATURE))
        b = held.select("leader", block(), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("key").alias("kb"), *(F.col(s).alias("b" + s) for s in SIGNATURE))
        meet = (a["leader"] == b["leader"]) & (a["block"] == b["block"]) & F.expr("kb < ka") & F.expr(similar) & F.expr(enough) & alike
        rest = a.join(b, meet).select("a", "na", "b", "nb").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti").select("a", "na", "b", "nb")
        rest = tmp.table(rest, "pairs")
        if not rest.isEmpty():
            late = late.union(matched(rest))

        marked = firsts.join(late.withColumn("late", F.lit(True)), "node", "left").filter("late or copies > 1")
        marked = marked.select("node", F.col("key").alias("first"), F.coalesce("late", F.lit(False)).alias("late"))
        out = rows.select(key.alias("key"), "node", "n").join(marked, "node").filter("late or not (key <=> first)")
        return tmp.keep(out.select("key.doc_id", "key.h", "key.line_no", F.col("n").cast("long").alias("n_shingles")))


def without_lines(df: DataFrame, late: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the lines that ``late`` names; all columns stay, and other rows are as they were.

    Rows of which nothing but blank lines is left go, for all that they say is in
    earlier rows.  Rows that had no words to begin with stay.
    """
    gone = late.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_list(F.col("line_no")).alias("__gone"))
    on = df[id_col].cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(df[id_col].cast("long"), df[text_col].cast("string")) == gone["__h"])
    joined = df.join(gone, on, "left")
    lines = F.split(df[text_col], "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), df[text_col]).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    told = joined.withColumn("__text", text).filter(F.col("__gone").isNull() | F.col("__text").rlike("[^\\x20\\x09-\\x0D]"))
    return told.select(*(F.col("__text").alias(c) if c == text_col else df[c] for c in df.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "n_shingles")


#: Ids are unique in the tables, so lines are in the order of (doc_id, line_no).
OP10_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
     lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM split),
     s AS (SELECT DISTINCT doc_id, line_no, g FROM ({shingles_sql("doc_id, line_no", "lines")})),
     n AS (SELECT doc_id, line_no, count(*) AS n FROM s GROUP BY 1, 2),
     pairs AS (SELECT y.doc_id, y.line_no, x.doc_id AS d, x.line_no AS l, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND (x.doc_id, x.line_no) < (y.doc_id, y.line_no) GROUP BY ALL)
SELECT DISTINCT p.doc_id, p.line_no, y.n AS n_shingles
FROM pairs p JOIN n y ON y.doc_id = p.doc_id AND y.line_no = p.line_no JOIN n x ON x.doc_id = p.d AND x.line_no = p.l
WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)
"""
