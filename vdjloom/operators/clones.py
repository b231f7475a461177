"""Clonotypes: counting, ranking and the tables behind the treemap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.functions.text import pct, strip
from vdjloom.operators.ranking import running

# How many colours clones are drawn in, and the first one's place.
COLOURS, FIRST_COLOUR = 43, 123


def clone_counts(df: DataFrame, keys: list[str], cdr3: list[str] | None = None) -> DataFrame:
    """(*keys, v_call, j_call, cdr3_aa, record_count) over productive rows with a CDR3,
    counting records, not copies. cdr3: columns of which the first that is not blank counts."""
    seq = F.coalesce(*(F.when(strip(c) != "", F.col(c)) for c in cdr3 or ["cdr3_aa"]))
    rows = df.filter(F.col("productive") == "T").select(*keys, "v_call", "j_call", seq.alias("cdr3_aa")).filter("cdr3_aa is not null")
    return rows.groupBy(*keys, "v_call", "j_call", "cdr3_aa").agg(F.count(F.lit(1)).alias("record_count"))


def clone_top(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Every clone with its rank in its sample and chain (count descending, then V, J, CDR3),
    its share and the running share in percent. Samples of any size: see running()."""
    order = [F.desc("record_count"), F.asc("v_call"), F.asc("j_call"), F.asc("cdr3_aa")]
    r = running(counts, keys, order, "record_count", "rank", "_run", "_total")
    return r.select(
        *keys, "rank", "v_call", "j_call", "cdr3_aa", "record_count",
        pct(F.col("record_count"), F.col("_total")).alias("frequency_percent"), pct(F.col("_run"), F.col("_total")).alias("cumulative_frequency_percent"),
    )


def _squarify(parents: DataFrame, children: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """children with the rectangle (x, y, w, h) of each in its parent's, in strips whose rectangles stay
    near squares; areas go by `_size`, and a parent's `_size` is the sum over its children.

    parents: (*within, _size, x, y, w, h). A parent's row goes before its children in one sorted stream, so
    that a task holds a batch of rows and the strip being filled, never a parent's whole set.
    """
    schema, names = children.schema, children.columns
    for c in "xywh":
        schema = schema.add(c, "double")
    head = parents.select(F.lit(0).alias("_child"), *within, "_size", *"xywh")
    stream = head.unionByName(children.withColumn("_child", F.lit(1)), allowMissingColumns=True)
    by = [F.col("_size").desc(), *(F.col(c).asc_nulls_last() for c in order)]
    stream = stream.repartition(*within).sortWithinPartitions(*within, "_child", *by)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = y = w = h = scale = total = 0.0
        strip: list[float] = []  # areas, falling
        done: list[tuple[float, float, float, float]] = []
        held: pa.Table | None = None

        def close() -> None:
            nonlocal x, y, w, h, total
            wide = w >= h
            side, at = (h, y) if wide else (w, x)
            thick = total / side if side > 0 else 0.0
            end = at + side
            for k, a in enumerate(strip, 1):
                length = end - at if k == len(strip) else a / thick if thick else 0.0
                done.append((x, at, thick, length) if wide else (at, y, length, thick))
                at += length
            if wide:
                x, w = x + thick, w - thick
            else:
                y, h = y + thick, h - thick
            strip.clear()
            total = 0.0

        def placed() -> Iterator[pa.RecordBatch]:
            nonlocal held, done
            if done:
                out = held.slice(0, len(done))
                for c, v in zip("xywh", zip(*done)):
                    out = out.append_column(c, pa.array(v, pa.float64()))
                held, done = held.slice(len(done)).combine_chunks(), []
                yield from out.to_batches()

        for b in batches:
            rows = pa.Table.from_batches([b])
            own = rows.filter(pc.equal(rows["_child"], 1)).select(names)
            held = pa.concat_tables([held, own]) if held is not None else own
            for child, size, *box in zip(*(rows[c].to_pylist() for c in ("_child", "_size", *"xywh"))):
                if not child:
                    if strip:
                        close()
                    x, y, w, h = box
                    scale = w * h / size
                    continue
                a, side = size * scale, min(w, h)
                if strip:
                    s2, t2 = side * side, total * total
                    u2 = (total + a) * (total + a)
                    if side > 0 and max(s2 * strip[0] / u2, u2 / (s2 * a)) > max(s2 * strip[0] / t2, t2 / (s2 * strip[-1])):
                        close()
                strip.append(a)
                total += a
            yield from placed()
        if strip:
            close()
        yield from placed()

    return stream.mapInArrow(place, schema)


def clone_colour(v_call: str, j_call: str, cdr3: str) -> Column:
    """The place of a clone's colour among COLOURS, the same in every picture: from the first 48 bits of the md5 of its names joined by bars."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in (v_call, j_call, cdr3))))
    return ((F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + FIRST_COLOUR) % COLOURS).cast("int")


def treemap_layout(top: DataFrame, keys: list[str], width: float = 100.0, height: float = 100.0, settle=None) -> DataFrame:
    """The rectangle (x, y, w, h) of every clone, nested V, then J, then CDR3, with areas over its
    sample and chain's whole count, and a colour index from the clone's md5. V and J rectangles come from sums;
    equal sums go by name, clones by rank. The picture starts at the far corner, as the reference draws it.
    settle: a function that writes the clones and reads them back; else they are computed for each level."""
    colour = clone_colour("v_call", "j_call", "cdr3_aa").alias("colour")
    leaves = top.filter("record_count > 0").select(*keys, "v_call", "j_call", "rank", F.col("record_count").cast("bigint").alias("_size"), colour)
    leaves = settle(leaves) if settle else leaves
    v, j = [*keys, "v_call"], [*keys, "v_call", "j_call"]
    j_sums = leaves.groupBy(*j).agg(F.sum("_size").alias("_size"))
    v_sums = j_sums.groupBy(*v).agg(F.sum("_size").alias("_size"))
    root = v_sums.groupBy(*keys).agg(F.sum("_size").alias("_size"))
    root = root.withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "w": F.lit(float(width)), "h": F.lit(float(height))})
    v_boxes = _squarify(root, v_sums, keys, ["v_call"])
    j_boxes = _squarify(v_boxes, j_sums, v, ["j_call"])
    boxes = _squarify(j_boxes, leaves, j, ["rank"])
    far_x, far_y = F.lit(float(width)) - F.col("x") - F.col("w"), F.lit(float(height)) - F.col("y") - F.col("h")
    return boxes.select(*keys, "rank", far_x.alias("x"), far_y.alias("y"), "w", "h", "colour")
