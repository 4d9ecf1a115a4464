"""Mix documents to target domain weights, with DataFrame expressions only.

A naive Bayes classifier learned from a labelled table gives every document a posterior for
each domain. Its inputs are counts of learned words and shares of sign classes, in bins. Then
every document gets a rate >= 0, its expected number of copies, so that the expected tokens of
each domain match the targets: least squares on the box [0, upper] by projected gradient with
momentum, started from 1 for all. A domain asked for more than it holds is asked for what it
holds, so the fit is of what will really be kept; where targets still cannot be met together
the result is the least-squares compromise, and the fit says so. A step needs the expected
tokens of each domain, a sum over the distinct posteriors. Their rates are written every
``FOLD`` steps, so a step folds at most that many earlier ones; a document's rate follows from
its own posterior and all steps, and is worked out once for each distinct posterior.

Bounded by parameters: words are learned from at most ``sample`` labelled documents, ``words``
a domain; bins and steps are few. Everything else covers all rows.

Edge cases: a NULL text is empty; empty texts have 0 tokens and a posterior from their bins;
labels with a NULL domain or of unknown documents are ignored; a labelled domain without
documents or a target without documents cannot be matched, its tokens stay where they are;
without labels all posteriors are equal; equal rows get equal rates and copies; an empty table
gives no rows; other columns pass through ``mix``.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.sampling import hash_sample
from tallyspark.sources.workspace import discard, settle

log = logging.getLogger(__name__)

#: Upper ends of bins; a value above all of them is in the last bin.
SHARES = (0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)
RATIOS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
HITS = (0.5, 1.5, 2.5, 4.5)
SIGNS = r"[#*$%&|<>!{}\[\]\\^~@=_]"
#: A word three times or more in a row.
RUNS = r"(?<!\S)(\S++)(?:\s\1){2,}(?!\S)"
UPPER = r"[A-ZÀ-ÖØ-Þ]"
#: Steps after which the rates of the distinct posteriors are written.
FOLD = 20
#: Distinct posteriors a task takes in a step.
POSTERIORS = 50_000


@dataclass(frozen=True)
class Settings:
    sample: int = 4000
    words: int = 16
    least_documents: int = 5
    least_log_odds: float = 3.0
    steps: int = 400
    stall: int = 30
    tolerance: float = 1e-2


@dataclass(frozen=True)
class Model:
    """Bounded: learned words and, for each feature and bin, log likelihoods of the domains."""

    domains: tuple[str, ...]
    words: tuple[tuple[str, ...], ...]
    prior: tuple[float, ...]
    likelihood: tuple[tuple[tuple[float, ...], ...], ...]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _bin(value: Column, ends: tuple[float, ...]) -> Column:
    return reduce(lambda a, b: a + b, [(value > e).cast("int") for e in ends])


def measure(docs: DataFrame, words: tuple[tuple[str, ...], ...], *keep: str) -> DataFrame:
    """The columns ``keep``, ``_m_tokens`` (words between single spaces, the unit of weight) and
    ``_m_bins``, one bin number a feature.

    In steps, so that the lower-cased and the split text are made once a row.
    """
    parts = docs.select(
        *keep,
        _text().alias("_m_text"),
        F.lower(_text()).alias("_m_lower"),
        F.split(_text(), " ").alias("_m_parts"),
    )
    text, size = F.col("_m_text"), F.greatest(F.length("_m_text"), F.lit(1))

    def share(signs: str) -> Column:
        return F.regexp_count(text, F.lit(signs)) / size

    values = [
        (share(SIGNS), SHARES),
        (share(UPPER), SHARES),
        (F.regexp_count(text, F.lit(RUNS)) / F.size("_m_parts"), SHARES),
        (F.length(text).cast("double"), (200.0, 1000.0, 5000.0, 20000.0)),
        (F.size(F.array_distinct("_m_parts")) / F.size("_m_parts"), RATIOS),
    ]
    for group in words:
        if group:
            hits = [F.contains(F.col("_m_lower"), F.lit(w)).cast("int") for w in group]
            values.append((reduce(lambda a, b: a + b, hits).cast("double"), HITS))
    tokens = F.when(F.length(text) == 0, 0).otherwise(F.size("_m_parts")).cast("bigint")
    valued = parts.select(
        *keep, tokens.alias("_m_tokens"), *[v.alias(f"_m_{i}") for i, (v, _) in enumerate(values)]
    )
    bins = F.array(*[_bin(F.col(f"_m_{i}"), ends) for i, (_, ends) in enumerate(values)])
    return valued.select(*keep, "_m_tokens", bins.alias("_m_bins"))


def fit(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> Model:
    return fit_measured(docs, labelled, settings)[0]


def fit_measured(
    docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()
) -> tuple[Model, DataFrame]:
    """The model, and all documents as ``measure`` sees them, written once.

    ``labelled``: doc_id and domain (text). Domains are in alphabetical order.
    """
    known = labelled.where("domain IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "domain").distinct()
    sample = settle(hash_sample(known, settings.sample, "doc_id"), "mix-sample")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    spoken = chosen.select("domain", F.explode(F.array_distinct(F.split(F.lower(_text()), r"[^\p{L}]+"))).alias("w"))
    by_word = spoken.where(F.length("w") > 2).groupBy("w", "domain").agg(F.count(F.lit(1)).alias("n"))
    by_word = settle(by_word, "mix-words")
    sizes = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = tuple(sorted(sizes))
    everywhere = by_word.groupBy("w").agg(F.sum("n").alias("all"))
    total = sum(sizes.values())
    inside = F.element_at(F.create_map(*[F.lit(x) for d in domains for x in (d, float(sizes[d]))]), F.col("domain")) if domains else F.lit(0.0)
    odds = F.log((F.col("n") + 0.5) / (inside + 1)) - F.log((F.col("all") - F.col("n") + 0.5) / (total - inside + 1))
    telling = (
        by_word.join(everywhere, "w")
        .where(F.col("n") >= settings.least_documents)
        .where(odds >= settings.least_log_odds)
        .withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n"), "w")))
        .where(F.col("place") <= settings.words)
    )
    chosen_words = sorted((r.domain, r.place, r.w) for r in telling.collect())
    words = tuple(tuple(w for d, _, w in chosen_words if d == domain) for domain in domains)
    measured = settle(measure(docs, words, "doc_id"), "mix-measured")
    binned = measured.join(known, "doc_id")
    counted = binned.select("domain", F.posexplode("_m_bins").alias("f", "b")).groupBy("domain", "f", "b")
    counts = {(r.domain, r.f, r.b): r.n for r in counted.agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths = [len(SHARES), len(SHARES), len(SHARES), 4, len(RATIOS), *[len(HITS) for g in words if g]]
    mass = [sum(n for (d, f, _), n in counts.items() if d == domain and f == 0) for domain in domains]
    likelihood = tuple(
        tuple(
            tuple(
                math.log((counts.get((domain, f, b), 0) + 0.1) / (mass[k] + 0.1 * (bins + 1)))
                for k, domain in enumerate(domains)
            )
            for b in range(bins + 1)
        )
        for f, bins in enumerate(lengths)
    )
    prior = tuple(math.log((m + 1) / (sum(mass) + len(domains))) for m in mass)
    return Model(domains, words, prior, likelihood), measured


def posteriors(model: Model) -> Column:
    """An array of the probabilities of ``model.domains`` for the row's ``_m_bins``."""
    if not model.domains:
        return F.array().cast("array<double>")
    table = F.lit([[list(v) for v in feature] for feature in model.likelihood])
    scores = F.aggregate(
        F.arrays_zip(F.col("_m_bins").alias("b"), table.alias("l")),
        F.lit(list(model.prior)),
        lambda a, x: F.zip_with(a, F.element_at(x["l"], x["b"] + 1), lambda p, q: p + q),
    )
    return F.transform(F.array(scores), _softmax)[0]


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(
        F.array(powers),
        lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda a, b: a + b)),
    )[0]


@dataclass(frozen=True)
class Fit:
    """Steps of the projected gradient, and what they reach.

    ``steps``: per step the momentum and the scaled gradient of each domain; ``upper``: the
    rate's upper end. ``wanted``: expected tokens of each domain (share of all tokens), the
    targets times the budget; ``reachable``: the least of wanted and what the domain holds at
    rate ``upper``; ``reached``: what the rates give; ``converged``: all within tolerance of
    ``reachable`` (relative), else the least-squares compromise on the box.
    """

    steps: tuple[tuple[float, ...], ...]
    upper: float
    wanted: tuple[float, ...] = ()
    reachable: tuple[float, ...] = ()
    reached: tuple[float, ...] = ()
    converged: bool = True


def _numbers(steps: list[tuple[float, ...]]) -> Column:
    """The steps as one literal: a text that Spark reads once a plan, not a node of the plan for each
    number, which every pass would leave behind in the driver's memory."""
    return F.from_json(F.lit(json.dumps([[float(x) for x in step] for step in steps])), "array<array<double>>")


def _state(chances: Column, steps: Column, upper: float, init: Column) -> Column:
    """(r, prev): the rate after the steps, from (r, prev) before, and the one before; a step is
    r' = clip(y - p . g, 0, upper) at y = r + beta * (r - prev)."""

    def move(acc: Column, step: Column) -> Column:
        y = acc["r"] + F.element_at(step, 1) * (acc["r"] - acc["prev"])
        pulls = F.zip_with(chances, F.slice(step, 2, F.size(step) - 1), lambda p, g: p * g)
        pull = F.aggregate(pulls, F.lit(0.0), lambda a, b: a + b)
        new = F.least(F.lit(upper), F.greatest(F.lit(0.0), y - pull))
        return F.struct(new.alias("r"), acc["r"].alias("prev"))

    return F.aggregate(steps, init, move)


def _start(upper: float) -> Column:
    start = F.lit(float(min(1.0, upper)))
    return F.struct(start.alias("r"), start.alias("prev"))


def rates(probabilities: Column, fit: Fit) -> Column:
    """The rate of a document with these domain probabilities after the fitted steps."""
    # Bound to a variable, so that the posterior is worked out once a row and not once a step.
    steps = _numbers(list(fit.steps))
    return F.transform(F.array(probabilities), lambda c: _state(c, steps, fit.upper, _start(fit.upper))["r"])[0]


def rated(weighted: DataFrame, fit: Fit) -> DataFrame:
    """``weighted`` with the column ``rate``, worked out once for each distinct ``p``."""
    known = settle(weighted.select("p").distinct().withColumn("rate", rates(F.col("p"), fit)), "mix-rates")
    return weighted.join(known, "p").select(*weighted.columns, "rate")


def fit_rates(
    weighted: DataFrame, targets: list[float], budget: float, upper: float = 1.0, settings: Settings = Settings()
) -> Fit:
    """Rates in [0, ``upper``] whose expected tokens of each domain meet the reachable targets.

    ``weighted``: tokens and p. ``targets``: the share of each domain; ``budget``: expected tokens,
    as a multiple of all tokens. A domain that holds less than it is asked for at rate ``upper``
    is asked for what it holds. Least squares of residuals, each divided by the larger of its
    target and the domain's sum of tau * p^2 (so every term's curvature is at most 1 and no rare
    domain dwarfs the rest), minimised by projected gradient on the box with a step length for
    each domain's direction and Nesterov momentum, restarted when the objective rises. Each step
    is one pass over the distinct posteriors, from the rates last written.
    Ends when every residual is within ``tolerance`` of its target (relative), when the
    objective stops falling, or after ``steps`` steps; the last two are logged as not met.
    """
    domains = range(len(targets))
    # Equal posteriors have equal rates: a step reads a row for each combination of bins seen.
    weighted = settle(weighted.groupBy("p").agg(F.sum("tokens").alias("tokens")), "mix-groups")
    first = weighted.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("tokens").alias("all"),
        *[F.sum(F.col("tokens") * F.col("p")[d]).alias(f"m{d}") for d in domains],
        *[F.sum(F.col("tokens") * F.col("p")[d] * F.col("p")[d]).alias(f"q{d}") for d in domains],
    ).first()
    if not first["all"]:
        return Fit((), upper)
    total = float(first["all"])
    held = [upper * (first[f"m{d}"] or 0.0) / total for d in domains]
    square = [(first[f"q{d}"] or 0.0) / total for d in domains]
    scale = sum(targets) or 1.0
    wanted = [budget * t / scale for t in targets]
    goal = [min(w, h) for w, h in zip(wanted, held, strict=True)]
    weight = [1.0 / max(g, q, 1e-12) for g, q in zip(goal, square, strict=True)]
    # A length for each domain's direction: the inverse of its term's curvature in the metric of
    # tokens, shared among the domains so that their sum cannot overshoot.
    lengths = [1.0 / (2.0 * len(targets) * w * max(q, 1e-300)) for w, q in zip(weight, square, strict=True)]
    steps: list[tuple[float, ...]] = []
    best, best_at, k, beta = float("inf"), 0, 0, 0.0
    converged = False
    tasks = -(-first["rows"] // POSTERIORS)

    def held(table: DataFrame) -> DataFrame:
        # Kept by the executors (and read again from its files if one is lost): a pass over files
        # leaves a copy of the file system's settings in the driver, a pass over kept rows nothing.
        return table.coalesce(tasks).persist()

    written, saved = weighted.withColumn("s", _start(upper)), 0
    kept = held(written)
    # Put together once: a pass brings only its numbers, as the columns ``steps`` and ``beta``. In
    # a lambda, new numbers do not make Spark compile the pass again.
    moved = [F.col("tokens"), F.col("p"), _state(F.col("p"), F.col("steps"), upper, F.col("s")).alias("s")]
    ahead = F.transform(
        F.array("s"), lambda s: F.struct(s["r"].alias("r"), (s["r"] + F.col("beta") * (s["r"] - s["prev"])).alias("y"))
    )[0].alias("s")
    pass_sums = [
        F.sum(F.col("tokens") * F.col(f"s.{v}") * F.col("p")[d]).alias(f"{v}{d}") for v in ("r", "y") for d in domains
    ]
    while True:
        if len(steps) - saved >= FOLD:
            state = kept.withColumn("steps", _numbers(steps[saved:])).select(*moved)
            state = settle(state, "mix-state")
            kept.unpersist()
            if saved:
                discard(written)
            written, saved = state, len(steps)
            kept = held(written)
        state = kept.withColumn("steps", _numbers(steps[saved:])).select(*moved)
        sums = state.withColumn("beta", F.lit(beta)).select("tokens", "p", ahead).agg(*pass_sums).collect()[0]
        reached = [(sums[f"r{d}"] or 0.0) / total for d in domains]
        at_y = [(sums[f"y{d}"] or 0.0) / total for d in domains]
        value = sum(w * (e - g) ** 2 for w, e, g in zip(weight, reached, goal, strict=True))
        off = max((abs(e - g) / g if g > 0 else e for e, g in zip(reached, goal, strict=True)), default=0.0)
        if off <= settings.tolerance:
            converged = True
            break
        if value < best * (1 - 1e-9):
            best, best_at = value, len(steps)
        if len(steps) - best_at >= settings.stall or len(steps) >= settings.steps:
            break
        if value > best and beta > 0:
            k, beta, at_y = 0, 0.0, reached  # restart: the momentum overshot
        gradient = [n * 2 * w * (e - g) for n, w, e, g in zip(lengths, weight, at_y, goal, strict=True)]
        steps.append((beta, *gradient))
        k += 1
        beta = (k - 1) / (k + 2)
    kept.unpersist()
    if not converged:
        log.warning("mixing: targets not met after %d steps; reachable %s, reached %s", len(steps), goal, reached)
    return Fit(tuple(steps), upper, tuple(wanted), tuple(goal), tuple(reached), converged)


def copies(rate: Column) -> Column:
    """Whole copies whose expectation is the rate, settled by a hash of the id."""
    luck = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + luck)


def weigh(docs: DataFrame, model: Model, measured: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``tokens`` and ``p`` of every document, written once for the steps to read."""
    measured = measure(docs, model.words, "doc_id") if measured is None else measured
    p = posteriors(model).alias("p")
    return settle(measured.select("doc_id", F.col("_m_tokens").alias("tokens"), p), "mix-weights")


def mix(
    docs: DataFrame,
    model: Model,
    targets: dict[str, float],
    budget: float,
    upper: float = 1.0,
    settings: Settings = Settings(),
    measured: DataFrame | None = None,
) -> DataFrame:
    """The documents, each as often as its rate settles on (at most ``ceil(upper)`` times); no
    shuffle of texts. The fit is kept as ``mixed.fit``. All input columns come back as they were,
    whatever their names: they travel as one struct beside ``doc_id`` and ``text``."""
    if measured is None:
        measured = settle(measure(docs, model.words, "doc_id"), "mix-measured")
    weighted = weigh(docs, model, measured)
    fit = fit_rates(weighted, [targets.get(d, 0.0) for d in model.domains], budget, upper, settings)
    # Equal bins have equal rates; the bins of documents are whole numbers and so safe to join by.
    known = measured.select("_m_bins").distinct().withColumn("_m_rate", rates(posteriors(model), fit))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_m_row"), docs["doc_id"], docs["text"])
    seen = measure(row, model.words, "_m_row", "doc_id").join(settle(known, "mix-rates"), "_m_bins")
    rated = seen.withColumn("_m_copies", copies(F.col("_m_rate")))
    # Exploded, not filtered: a filter would be pushed below and repeat the work on the text for every bin.
    again = F.explode(F.array_repeat(F.lit(1), F.col("_m_copies").cast("int")))
    mixed = rated.withColumn("_m_copy", again).select("_m_row.*")
    mixed.fit = fit
    return mixed


def label_domains(labels: DataFrame) -> DataFrame:
    """``toxic``, ``low`` or ``clean`` from the two label columns."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
