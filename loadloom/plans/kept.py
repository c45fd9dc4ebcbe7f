"""Refits from kept moments: a table of the moments of each chunk of a series, under one version of its shapes.

A daily refit then reads the chunk that has grown, and those that were revised; the others enter by their stored moments. A version ends with
its shapes (and the span that sets its knots): new shapes make all blocks anew.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom import config as C
from loadloom.operators.timeaxis import SERIES
from loadloom.plans import fit as M
from loadloom.plans.chunks import BEFORE, DAYS
from loadloom.plans.design import Layout

STAGE = M.Stage(shapes=(), passes=1)
BLOCK = f"{SERIES} string, fold string, chunk int, n long, n_mild long, gram binary"
#: A chunk's rows before the last refit are its segment 0, those since its segment 1.
_PARTS = 2


def chunk_of(ts):
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01")) / DAYS).cast("int")


def merged(parts: DataFrame, layout: Layout, params: DataFrame) -> DataFrame:
    """One block for each series, version and chunk, from the tasks' moments or from blocks to be added up."""
    spans = params.select(SERIES, "fold", "span")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        lay = replace(layout, span_days=int(pdf["span"].iloc[0]))
        g = sum(M.unpacked(p.kind, p.data, lay.width + 1) for p in pdf.itertuples())
        data = g[np.triu_indices(len(g))].astype("<f8").tobytes()
        return pd.DataFrame({SERIES: [pdf[SERIES].iloc[0]], "fold": [pdf["fold"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "n": [pdf["n"].sum()], "n_mild": [pdf["n_mild"].sum()], "gram": [data]})

    return parts.join(spans, [SERIES, "fold"]).groupBy(SERIES, "fold", "chunk").applyInPandas(join, BLOCK)


def as_parts(blocks: DataFrame) -> DataFrame:
    return blocks.select(SERIES, "fold", "chunk", F.lit(1).alias("kind"), "n", "n_mild", F.col("gram").alias("data"))


def seen(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, since: bool) -> DataFrame:
    """Moments of ``chunks``, by chunk; with ``since``, only of the rows at or after the version's ``since`` instant."""
    cut = F.array("since") if since else F.array(F.lit(-M.FAR))
    folds = M.start(params.select(SERIES, "fold", F.col("span").alias("_span"), F.col("theta").alias("_theta"), F.col("until").alias("_until"), cut.alias("_cuts")), layout, columns={"fold": F.col("fold"), "span": F.col("_span"), "theta": F.col("_theta"), "until": F.col("_until"), "cuts": F.col("_cuts")})
    found = M.moments(chunks, folds, layout, step_hours, STAGE, by_chunk=_PARTS)
    parts = found.withColumn("chunk", F.floor(F.col("segment") / _PARTS).cast("int")).filter(F.pmod("segment", F.lit(_PARTS)) == 1)
    return parts.select(SERIES, "fold", "chunk", "kind", "n", "n_mild", "data")


def blocks(chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float) -> DataFrame:
    """All blocks of a version. ``params``: series_id, fold (the version), span, theta, until (rows before it are known)."""
    return merged(seen(chunks, params, layout, step_hours, False), layout, params)


def refreshed(stored: DataFrame, chunks: DataFrame, params: DataFrame, layout: Layout, step_hours: float, revised: DataFrame | None = None) -> DataFrame:
    """The blocks at a later ``until`` of the same version. ``params`` also has ``since``, the until of the stored blocks. ``revised``: series_id,
    ts of rows before it that have changed.

    The rows since then are added to their chunks' blocks. A chunk with revised rows is made anew, and so are the two after it, whose filters
    remember its weather: the old rows' moments needn't be subtracted, so no error adds up over many revisions.
    """
    ends = params.select(SERIES, chunk_of(F.timestamp_seconds("since")).alias("_open"))
    grown = chunks.join(ends, SERIES).filter(F.col("chunk") >= F.col("_open")).drop("_open")
    if revised is None:
        return merged(as_parts(stored).unionByName(seen(grown, params, layout, step_hours, True)), layout, params)
    stale = revised.select(SERIES, F.explode(F.sequence(chunk_of("ts"), chunk_of("ts") + BEFORE)).alias("chunk")).distinct()
    old = stored.join(stale, [SERIES, "chunk"], "left_anti")
    more = seen(grown.join(stale, [SERIES, "chunk"], "left_anti"), params, layout, step_hours, True)
    again = seen(chunks.join(stale, [SERIES, "chunk"], "left_semi"), params, layout, step_hours, False)
    return merged(as_parts(old).unionByName(more).unionByName(again), layout, params)


def coefficients(blocks_of: DataFrame, params: DataFrame, layout: Layout) -> DataFrame:
    """series_id, fold, span, theta, coef, rmse, n of each series, from its blocks alone."""
    own = params.select(SERIES, "fold", "span", "theta")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        lay = replace(layout, span_days=int(pdf["span"].iloc[0]))
        g = sum(M.unpacked(1, x, lay.width + 1) for x in pdf["gram"])
        n, n_mild = int(pdf["n"].sum()), int(pdf["n_mild"].sum())
        coef, sse, _, _ = M.solved(STAGE, lay, g, n, n_mild, np.zeros(0))
        first = pdf.iloc[0]
        return pd.DataFrame({SERIES: [first[SERIES]], "fold": [first["fold"]], "span": [lay.span_days], "theta": [list(first["theta"])], "coef": [coef.tolist()], "rmse": [float(np.sqrt(sse / n))], "n": [n]})

    schema = f"{SERIES} string, fold string, span int, theta array<double>, coef array<double>, rmse double, n long"
    return blocks_of.join(own, [SERIES, "fold"]).groupBy(SERIES, "fold").applyInPandas(finish, schema)


def decided(states: DataFrame, revisions: DataFrame, now) -> DataFrame:
    """series_id, fitted_at, shapes_at, revised_rows, what: what each series' stored state asks for at the instant ``now``, by the rules of
    ``operation.refit``. ``states``: series_id, fitted_at, shapes_at (null: none). ``revisions``: series_id, and a row for each revised row."""
    counts = revisions.groupBy(SERIES).agg(F.count("*").alias("revised_rows"))
    rows = states.join(counts, SERIES, "left").fillna(0, ["revised_rows"])
    days = lambda c: F.floor((F.unix_timestamp(now) - F.unix_timestamp(c)) / 86400)
    stale = (days("fitted_at") >= C.REFIT["linear_days"]) | (F.col("revised_rows") >= C.REFIT["revised_rows"])
    what = F.when(F.col("shapes_at").isNull() | (days("shapes_at") >= C.REFIT["shape_days"]), "shapes").when(stale, "linear").otherwise("keep")
    return rows.select(SERIES, "fitted_at", "shapes_at", "revised_rows", what.alias("what"))
