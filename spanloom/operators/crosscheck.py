"""What a format's parser found against what the carver found on the same images: every disagreement as a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import extent_overlaps

#: Share of the carver's bytes beyond the parser's from which they are told (fixed).
EXTRA = 0.02


def disagreements(parsed: DataFrame, carved: DataFrame, width: int, tolerance: float = 0.5) -> DataFrame:
    """(img, kind, parser_clip, carver_clip, expected, found): five kinds of disagreement.

    parsed: (img, id, codec, frames, exportable, extents), carved: (img, id, codec, frames, extents); extents are arrays of
    (s, e), disjoint within a clip. An exportable parser clip belongs to the carver's clip that shares most bytes with it
    (of equals the least id), if they share `tolerance` of it. Carver clips that no parser clip of any kind touches are
    told too. expected and found are bytes for missing clips (found null), frames, codecs or bytes of the other kinds.
    """
    spans = lambda d: d.select("img", "id", F.explode("extents").alias("x")).select("img", "id", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    size = F.aggregate("extents", F.lit(0).cast("long"), lambda a, x: a + F.greatest(F.lit(0), x["e"] - x["s"]))
    p, g = parsed.withColumn("size", size), carved.withColumn("size", size)
    shared = extent_overlaps(spans(p), spans(g), ["img"], width)
    best = shared.groupBy("img", "l").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "r")).alias("b")).select("img", F.col("l").alias("id"), F.col("b.r").alias("r"), (-F.col("b.o")).alias("overlap"))
    own = p.where("exportable").join(best, ["img", "id"], "left")
    enough = F.coalesce(F.col("overlap") >= tolerance * F.col("size"), F.lit(False))
    text = lambda c: c.cast("string")
    row = lambda d, kind, expected, found, parser=F.col("id"), carver=F.col("r"): d.select("img", F.lit(kind).alias("kind"), parser.alias("parser_clip"), carver.alias("carver_clip"), text(expected).alias("expected"), text(found).alias("found"))
    none = F.lit(None).cast("long")
    matched = own.where(enough)
    both = matched.join(g.select("img", F.col("id").alias("r"), F.col("codec").alias("codec_g"), F.col("frames").alias("frames_g"), F.col("size").alias("size_g")), ["img", "r"])
    extra = F.col("size_g") - F.col("overlap")
    touched = shared.select("img", F.col("r").alias("id")).distinct()
    # a clip that belongs to a parser clip is touched by it
    alone = g.join(touched, ["img", "id"], "left_anti")
    out = row(own.where(~enough), "parser_clip_not_found_by_generic", F.col("size"), none, carver=none)
    out = out.unionByName(row(both.where(~F.col("codec").eqNullSafe(F.col("codec_g"))), "codec_mismatch", F.col("codec"), F.col("codec_g")))
    out = out.unionByName(row(both.where(~F.col("frames").eqNullSafe(F.col("frames_g"))), "frame_count_mismatch", F.col("frames"), F.col("frames_g")))
    out = out.unionByName(row(both.where(extra > EXTRA * F.greatest(F.lit(1), F.col("size_g"))), "generic_includes_extra_bytes", F.lit(0), extra))
    return out.unionByName(row(alone, "generic_clip_not_explained_by_parser", F.col("size"), none, parser=none, carver=F.col("id")))
