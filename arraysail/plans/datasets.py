"""The preparation of recordings as dataflows (DS01-DS12); downloads are not part of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arraysail.functions.scalar import onset_ms, rescaled, stem, take
from arraysail.operators import aggregates as A
from arraysail.operators import joins as J
from arraysail.operators import layout as L
from arraysail.operators import select as X
from arraysail.operators import setops as U
from arraysail.operators import windows as W


def presentations(metadata: DataFrame, stimulus: str, repetitions: Sequence[str], per_session: int = 750) -> DataFrame:
    """(stimulus, session, trial, presentation, repetition, run) from wide trial numbers, 0 for none (DS01).

    Repetitions follow the presentations, also where a stimulus has a trial number twice.
    """
    trials = X.nonzero(metadata, [stimulus], repetitions, "rep", "number")
    session, trial = L.div_mod("number", per_session)
    p = trials.select(F.col(stimulus).alias("stimulus"), session.alias("session"), trial.alias("trial"))
    p = W.global_position(p, (F.col("session") * per_session + F.col("trial")).cast("double"), "presentation", ["stimulus"])
    p = W.occurrence(p, ["stimulus"], ["session", "trial", "presentation"])
    return p.withColumn("run", L.run_label("trial"))


def betas(cells: DataFrame, masks: Sequence[tuple[DataFrame, Sequence[str], str]], z_score: bool = True, divisor: float = 300.0, session: str = "session", neuroid: str = "neuroid", value: str = "value") -> DataFrame:
    """Responses of the unmasked neuroids, scored within sessions or divided (DS01, DS02)."""
    return W.scale_by(X.mask_rows(cells, *masks), [session, neuroid], value, divisor, z_score)


def validity(cells: DataFrame, neuroid: str, session: str, n_sessions: int, valid: Column) -> DataFrame:
    """Neuroids that are valid in all of the first sessions (DS02)."""
    return X.all_of(cells.where(F.col(session) < n_sessions), [neuroid], valid)


def regions(volumes: Mapping[tuple[str, str], DataFrame], labels: DataFrame) -> DataFrame:
    """(source, hemisphere, label, name, cell) from label volumes and their tables (DS03, DS10)."""
    parts = {k: L.relabel(v, constants={"source": k[0], "hemisphere": k[1]}) for k, v in volumes.items()}
    return U.concat(parts).where("label <> 0").join(labels, ["source", "label"])


def annotation_counts(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """(stimulus, category, n) of the annotated images that are stimuli (DS04)."""
    a = J.lookup(annotations, images, "image_id")
    return J.lookup(a, categories, "category_id").groupBy("stimulus", "category").agg(F.count("*").alias("n"))


def captions(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """(stimulus, captions) in the order of the annotations (DS04)."""
    return A.lists(J.lookup(annotations, images, "image_id"), "stimulus", "annotation_id", "caption", "captions")


def stimulus_table(paths: DataFrame, conditions: DataFrame, sets: DataFrame) -> DataFrame:
    """Stimuli by file name with their condition's metadata and cross-validation set (DS06, DS12)."""
    s = paths.select(stem("path").alias("stimulus"), take(stem("path"), "_", 0).alias("condition"), "path")
    return J.membership(J.merge(s, conditions, "condition"), sets, "condition")


def assembly(subjects: Mapping[object, DataFrame], neuroid: str = "neuroid", value: str = "value", key: str = "subject", how: str = "any") -> DataFrame:
    """All subjects' cells without neuroids that have missing values (DS06, DS07)."""
    return X.drop_missing(U.concat(subjects, key), [key, neuroid], value, how)


def eeg_events(events: DataFrame, names: DataFrame) -> DataFrame:
    """Onsets in milliseconds, joined by place with the names of what was shown (DS09)."""
    return J.positional(events.withColumn("onset", onset_ms("sample")), names, "sample", "line")


def eeg_epochs(events: DataFrame, signal: DataFrame, low: float, high: float, size: int | float, step: int, scale: str | float = "original", n_main: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(event, channel, offset, mean): epochs around the onsets, scaled, with sliding means over their samples (DS09).

    events (pos, onset, ...), signal (channel, time, value). With ``n_main`` a
    column tells the main from the validation trials.
    """
    e = J.interval(events, signal, by, F.col("onset"), F.col("time"), low, high)
    if scale == "std":
        e = e.crossJoin(e.agg(F.stddev_pop("value").alias("__sd"))).withColumn("value", rescaled("value", "std", F.col("__sd"))).drop("__sd")
    else:
        e = e.withColumn("value", rescaled("value", scale))
    out = W.sliding_mean(e, [*by, "pos", "channel"], ["offset"], size, step, position="place")
    return out if n_main is None else out.withColumn("main", F.col("pos") < n_main)


def averaged_signal(signal: DataFrame, factor: int, keys: Sequence[str] = ("channel",), place: str = "n", value: str = "value") -> DataFrame:
    """A signal at a lower rate: means of ``factor`` samples each (DS09)."""
    return signal.groupBy(*keys, F.floor(F.col(place) / F.lit(factor)).cast("long").alias(place)).agg(F.avg(value).alias(value))


def filtered(signal: DataFrame, weights: Sequence[float], keys: Sequence[str] = ("channel",), place: str = "n", value: str = "value") -> DataFrame:
    """A finite impulse response along each channel, nought beyond its ends (DS09)."""
    from pyspark.sql import Window

    w, half = Window.partitionBy(*keys).orderBy(place), len(weights) // 2
    terms = [F.coalesce(F.lag(value, i - half).over(w), F.lit(0.0)) * F.lit(float(k)) for i, k in enumerate(weights)]
    return signal.withColumn(value, sum(terms[1:], terms[0]))


def without_catch(trials: DataFrame, stimulus: str, order: Sequence[str], prefix: str = "catch") -> DataFrame:
    """Trials without the catch ones, with their repetition (DS10)."""
    return W.occurrence(X.drop_prefixed(trials, stimulus, prefix), [stimulus], order)


def scored_by_spontaneous(responses: DataFrame, spontaneous: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Responses with their repetition, scored by spontaneous activity (DS11)."""
    return W.z_score_by(W.occurrence(responses, keys, order), spontaneous, keys, value)


def embeddings(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """Vectors by line with the names of their stimuli (DS08, DS12)."""
    return J.merge(vectors, names, "line")
