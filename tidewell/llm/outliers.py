"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Statistics of each text are transformed to near-symmetric scales; for each language and source their centre
and scatter are the minimum-covariance-determinant estimates: of all halves of the rows, that whose covariance has the
smallest determinant. Concentration steps look for it (keep the half nearest by Mahalanobis distance, take its
mean and covariance, and again: the determinant never rises) from four deterministic starts; after two steps the
start with the smallest determinant goes on until no cell's determinant falls. A small ridge keeps statistics usable
that are constant in a cell. Every step is two aggregations with partial sums, so the size of a source does not
matter. A text is rejected when its distance from the estimate is beyond the cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
STATS = ["mean_word", "symbol_rate", "repeat_rate", "line_rate", "upper_rate"]
#: The statistics of ordinary texts have heavier tails than a normal vector. For a t vector of 5 values and 10 degrees of
#: freedom the squared distance is 5 times an F(5, 10) variable: its median, and what it exceeds once in a million times.
_MEDIAN, _TAIL = 4.66, 246.8


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not once per use."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the text.

    Each window's hash is packed with its position and sorted; equal neighbours are repeats. Should two
    different hashes ever share their packed bits, membership is tested in full for that text.
    """
    low = (1 << 24) - 1

    def by_hash(hashes: Column) -> Column:
        n = F.size(hashes)
        packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

        def by_order(order: Column) -> Column:
            later, earlier = F.slice(order, F.lit(2), n - 1), F.slice(order, F.lit(1), n - 1)
            same = F.zip_with(earlier, later, lambda a, b: F.when(a.bitwiseXOR(b) <= low, F.when(a.bitwiseXOR(b) >= 0, F.struct(a.bitwiseAND(F.lit(low)).alias("i"), b.bitwiseAND(F.lit(low)).alias("j")))))
            at = lambda p: F.get(hashes, p.cast("int"))

            def by_pairs(pairs: Column) -> Column:
                clash = F.exists(pairs, lambda p: at(p["i"]) != at(p["j"]))
                quick = F.concat(F.transform(pairs, lambda p: p["i"]), F.transform(pairs, lambda p: p["j"]))
                places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))
                slow = F.transform(F.filter(places, lambda p: F.size(F.filter(hashes, lambda h: h == p["h"])) > 1), lambda p: p["i"])
                return F.sort_array(F.array_distinct(F.when(clash | (n > low), slow).otherwise(quick)))

            return _bind(_bind(F.filter(same, lambda p: p.isNotNull()), by_pairs), by_places)

        def by_places(places: Column) -> Column:
            k = F.size(places)
            gaps = F.zip_with(F.slice(places, F.lit(1), k - 1), F.slice(places, F.lit(2), k - 1), lambda a, b: F.least(F.lit(width).cast("long"), b - a))
            return F.when(k == 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(width).cast("long"), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("long")).otherwise(_bind(packed, by_order))

    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(n < width, F.lit(0).cast("long")).otherwise(_bind(windows, by_hash))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, tag and the counts of each text; a null text has no words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    line_counts = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    word_counts = _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    return docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.monotonically_increasing_id().alias("tag"),
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        line_counts.alias("by_line"),
        word_counts.alias("by_word"),
    ).select("doc_id", "lang", "source", "tag", "word_chars", "n_symbols", "n_upper", "by_line.n_lines", "by_line.n_dup_lines", "by_word.n_words", "by_word.n_repeat_words")


def _vector(n_words: Column) -> list[Column]:
    """The transformed statistics; each is defined for any text with a word, and square roots spread rates near 0."""
    return [
        F.log(F.col("word_chars") / n_words).alias(STATS[0]),
        F.sqrt(F.col("n_symbols") / n_words).alias(STATS[1]),
        F.sqrt(F.col("n_repeat_words") / n_words).alias(STATS[2]),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias(STATS[3]),
        F.sqrt(F.col("n_upper") / F.col("word_chars")).alias(STATS[4]),
    ]




_P = range(len(STATS))
_RIDGE = (0.02, 0.05, 0.15, 0.15, 0.03)
_NUMBERS = [*(f"m{i}" for i in _P), *(f"l{i}{j}" for i in _P for j in range(i + 1)), "logdet"]


def _distance(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance, for each estimate of their cell."""
    joined = rows.join(fit, "cell")
    z: list[Column] = []
    for i, name in enumerate(STATS):
        joined = joined.withColumn(f"z{i}", (F.col(name) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
        z.append(F.col(f"z{i}") * F.col(f"z{i}"))
    keep = [c for c in ("start",) if c in fit.columns]
    return joined.select(*rows.columns, *keep, sum(z[1:], z[0]).alias("d2"))


def _factor(fit: DataFrame, scatter, more: list[str]) -> DataFrame:
    """The estimates with the Cholesky factor of ``scatter(i, j)`` and its log determinant."""
    for i in _P:  # row by row, so that a row's values are made of columns of the rows before
        row: list[Column] = []
        for j in range(i + 1):
            rest = scatter(i, j)
            for k in range(j):
                rest = rest - row[k] * (row[k] if i == j else F.col(f"l{j}{k}"))
            row.append(F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
        fit = fit.withColumns({f"l{i}{j}": x for j, x in enumerate(row)})
    fit = fit.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in _P), F.lit(0.0)))
    return fit.select(*more, *_NUMBERS)


def _moments(of: list[Column], to: str) -> list[Column]:
    return [F.covar_pop(of[i], of[j]).alias(f"{to}{i}{j}") for i in _P for j in range(i + 1)]


def _estimate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and factored covariance of each group's rows."""
    fit = rows.groupBy(*by).agg(*(F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)), *_moments([F.col(s) for s in STATS], "c"))
    return _factor(fit, lambda i, j: F.col(f"c{i}{j}") + (_RIDGE[i] ** 2 if i == j else 0.0), by)


def _concentrate(rows: DataFrame, fit: DataFrame, accuracy: int) -> DataFrame:
    """One step of every estimate: mean and covariance of the half nearest to it."""
    by = ["cell", "start"] if "start" in fit.columns else ["cell"]
    far = _distance(rows, fit)
    # Written, so that Spark sees how small it is and need not deal the rows by cell.
    limit = materialize(far.groupBy(*by).agg(F.percentile_approx("d2", 0.5, accuracy).alias("limit")), "limit")
    return _estimate(far.join(limit, by).where("d2 <= limit"), by)


def _starts(rows: DataFrame, accuracy: int) -> DataFrame:
    """Four estimates a cell around the medians: median deviations, their correlation by tanh, by directions, and the inmost box."""
    middle = materialize(rows.groupBy("cell").agg(*(F.percentile_approx(s, 0.5, accuracy).alias(f"m{i}") for i, s in enumerate(STATS))), "middle")
    spread = rows.join(middle, "cell").groupBy("cell").agg(*(F.percentile_approx(F.abs(F.col(s) - F.col(f"m{i}")), 0.5, accuracy).alias(f"s{i}") for i, s in enumerate(STATS)))
    middle = materialize(middle.join(spread, "cell").select("cell", *(f"m{i}" for i in _P), *((1.4826 * F.col(f"s{i}") + _RIDGE[i]).alias(f"s{i}") for i in _P)), "middle")
    z = rows.join(middle, "cell").select("cell", *STATS, *(((F.col(s) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, s in enumerate(STATS)))
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in _P), F.lit(1e-12)))
    box = F.greatest(*(F.abs(f"z{i}") for i in _P))
    shapes = z.groupBy("cell").agg(*_moments([F.tanh(f"z{i}") for i in _P], "t"), *_moments([F.col(f"z{i}") / size for i in _P], "u"), F.percentile_approx(box, 0.5, accuracy).alias("limit"))
    shapes = materialize(shapes.join(middle, "cell"), "shapes")
    scaled = lambda x, i, j: x * F.col(f"s{i}") * F.col(f"s{j}")
    same = lambda i, j: F.lit(1.0 if i == j else 0.0)
    alike = lambda i, j: F.lit(1.0) if i == j else F.col(f"t{i}{j}") / F.sqrt((F.col(f"t{i}{i}") + 0.01) * (F.col(f"t{j}{j}") + 0.01))
    kinds = (same, alike, lambda i, j: len(STATS) * F.col(f"u{i}{j}") + 0.01 * same(i, j))
    each = [F.struct(F.lit(k).alias("start"), *(scaled(of(i, j), i, j).alias(f"c{i}{j}") for i in _P for j in range(i + 1))) for k, of in enumerate(kinds)]
    found = shapes.select("cell", *(f"m{i}" for i in _P), F.inline(F.array(*each)))
    found = _factor(found, lambda i, j: F.col(f"c{i}{j}"), ["cell", "start"])
    inmost = z.withColumn("box", box).join(shapes.select("cell", "limit"), "cell").where("box <= limit")
    inmost = _estimate(inmost, ["cell"]).select("cell", F.lit(len(kinds)).alias("start"), *_NUMBERS)
    return materialize(found.unionByName(inmost), "starts")


def mcd_estimates(rows: DataFrame, most_steps: int = 20, least_fall: float = 1e-3, accuracy: int = 10_000) -> DataFrame:
    """cell, m0.., l00.., logdet: the estimate of each cell of ``rows`` (a cell and the statistics).

    Steps go on until no cell's log determinant falls by ``least_fall``. The half is exact in cells of up to ``accuracy``
    rows, and within a share of 1 / ``accuracy`` of the rows beyond.
    """
    fit = _starts(rows, accuracy)
    fit = materialize(_concentrate(rows, fit, accuracy), "fit")
    least = F.min(F.struct("logdet", "start", *_NUMBERS[:-1])).alias("best")
    fit = _concentrate(rows, fit, accuracy).groupBy("cell").agg(least)
    fit = materialize(fit.select("cell", *(F.col(f"best.{n}").alias(n) for n in _NUMBERS)), "fit")
    for _ in range(most_steps):
        new = _concentrate(rows, fit, accuracy).join(fit.select("cell", F.struct(*_NUMBERS).alias("old")), "cell")
        fell = (F.col("old.logdet") - F.col("logdet")).alias("fell")
        better = F.col("logdet") < F.col("old.logdet")
        fit = materialize(new.select("cell", fell, *(F.when(better, F.col(n)).otherwise(F.col(f"old.{n}")).alias(n) for n in _NUMBERS)), "fit")
        falls = not fit.where(F.col("fell") > least_fall).isEmpty()
        fit = fit.drop("fell")
        if not falls:
            break
    return fit


def mcd_distances(rows: DataFrame, judged: DataFrame, most_steps: int = 20, least_fall: float = 1e-3, accuracy: int = 10_000) -> DataFrame:
    """``judged`` with ``d2`` from the estimate that ``rows`` give of their cell, scaled to its median there.

    The scaling makes the median distance that of a t vector, which also corrects for taking
    the covariance of the nearest rows only.
    """
    fit = mcd_estimates(rows, most_steps, least_fall, accuracy)
    scale = materialize(_distance(rows, fit).groupBy("cell").agg(F.percentile_approx("d2", 0.5, accuracy).alias("median")), "scale")
    far = _distance(judged, fit).join(scale, "cell")
    return far.withColumn("d2", F.col("d2") * F.lit(_MEDIAN) / F.greatest("median", F.lit(_MEDIAN / 4))).drop("median")


def quality_rules(docs: DataFrame, least_rows: int = 40, cutoff: float = _TAIL, most_steps: int = 20) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: under 50 words, or more than half of them in repeated windows. Others are judged within
    their language and source; those of cells with fewer than ``least_rows`` rows, eight a statistic, by the estimate
    of their language's rows, and if these are still fewer, by that of all rows. A corpus of fewer than two rows more than
    twice the statistics rejects nothing. A null language or source is a value of its own, a
    null text has no words and fails. Repeated rows are rows of their own; an empty table gives an
    empty result; further columns are ignored. ``cutoff`` is on the squared distance, scaled to a t vector's.
    """
    stats = materialize(text_statistics(docs), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed)
    vectors = rows.where("not base_failed").select("tag", "lang", "source", *_vector(F.col("n_words")))
    sizes = materialize(vectors.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "sizes")
    names = {"source": F.to_json(F.struct(F.lit("lang, source").alias("of"), "lang", "source")), "lang": F.to_json(F.struct(F.lit("lang").alias("of"), "lang")), "all": F.lit("all")}
    of_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang")).select(F.col("lang").alias("of_lang"), "n_lang")
    level = F.when(F.col("n") >= least_rows, "source").when(F.col("n_lang") >= least_rows, "lang").otherwise("all")
    cells = sizes.join(of_lang, F.col("lang").eqNullSafe(F.col("of_lang"))).withColumn("level", level)
    cell = F.when(F.col("level") == "source", names["source"]).when(F.col("level") == "lang", names["lang"]).otherwise(names["all"])
    cells = materialize(cells.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "n", "level", cell.alias("cell")), "cells")
    placed = vectors.join(cells, vectors["lang"].eqNullSafe(cells["of_lang"]) & vectors["source"].eqNullSafe(cells["of_source"]))
    placed = materialize(placed.select("tag", "lang", "level", "cell", *STATS), "vectors")
    levels = {r["level"] for r in cells.select("level").distinct().collect()}  # three at most
    basis = placed.where("level = 'source'").select("cell", *STATS)
    if "lang" in levels:
        small = cells.where("level = 'lang'").select(F.col("of_lang"), F.col("cell").alias("lang_cell")).distinct()
        basis = basis.unionByName(placed.drop("cell").join(small, F.col("lang").eqNullSafe(F.col("of_lang"))).select(F.col("lang_cell").alias("cell"), *STATS))
    if "all" in levels:
        basis = basis.unionByName(placed.withColumn("cell", names["all"]).select("cell", *STATS))
    enough = (cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) >= 2 * (len(STATS) + 1)
    far = mcd_distances(materialize(basis, "basis"), placed.select("tag", "cell", *STATS), most_steps).select("tag", F.col("d2").alias("distance")) if enough else placed.select("tag", F.lit(None).cast("double").alias("distance"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return rows.join(far, "tag", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
