"""Intervention policies: from a pair of posteriors to a decision.

What all policies need of a row (argmax, largest value, sum) is computed once, as
columns; a policy is then a small struct: its name, action, budget, coverage and
source. A grid of policies is one array of structs, exploded once, so the traces
are scanned once whatever the number of policies. The chosen vector follows from
the source after the explode, so queries that don't read it never build it. All of
it is stateless and runs unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.arrays import EPS, argmax, let, normalize, total

TAUS = (0.05, 0.10, 0.15, 0.20, 0.25)


def _d(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def decide(policy: Column | str, action: Column, tau: Column | float, coverage: Column, source: Column | str, weight: float = 0.0) -> Column:
    """The struct that all policies share; flags, losses and the vector follow from it (see expand).

    source tells whose vector is meant: user, defer (the user's), assist, agency_set
    (the assistant's), blend (the mixture by weight), agency_margin (the assistant's
    within the budget). A coverage outside [0, 1] is clipped.
    """
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        text(policy).alias("policy"),
        action.cast("int").alias("selected_action"),
        _d(tau).cast("double").alias("tau"),
        F.least(F.greatest(coverage, F.lit(0.0)), F.lit(1.0)).alias("coverage"),
        text(source).alias("source"),
        F.lit(float(weight)).alias("weight"),
    )


class Pair:
    """The two posteriors of a row with what every policy needs of them."""

    def __init__(self, p_user: str = "p_user", p_assist: str = "p_assist"):
        self.pu, self.pa = F.col(p_user), F.col(p_assist)
        self.u, self.a = argmax(self.pu), argmax(self.pa)
        self.cu, self.ca = F.array_max(self.pu), F.array_max(self.pa)
        self.su, self.sa = total(self.pu), total(self.pa)

    @property
    def ranked(self) -> Column:
        """The actions in the order in which any budget takes them: likelier to the assistant, then less loss, then first."""
        loss = lambda i: F.greatest(F.lit(0.0), self.cu - F.element_at(self.pu, i + 1))
        return F.array_sort(F.transform(_actions(self), lambda i: F.struct((-F.element_at(self.pa, i + 1)).alias("n"), loss(i).alias("ali"), i.alias("i"))))

    @property
    def user_share(self) -> Column:
        return F.when(self.su > 0, self.cu / self.su).otherwise(self.cu)

    @property
    def assist_share(self) -> Column:
        return F.when(self.sa > 0, self.ca / self.sa).otherwise(self.ca)


def user_only(p: Pair) -> Column:
    return decide("user_only", p.u, 0.0, p.user_share, "user")


def assist_only(p: Pair) -> Column:
    return decide("assist_only", p.a, 1.0, p.assist_share, "assist")


def mixture(p: Pair, weight: Column | float) -> Column:
    w = _d(weight)
    return F.zip_with(p.pu, p.pa, lambda x, y: (1 - w) * x + w * y)


def blend(p: Pair, weight: float) -> Column:
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie in [0, 1]")
    return let(normalize(mixture(p, weight)), lambda m: decide(f"confidence_blend_alpha_{weight:.2f}", argmax(m), 1.0, F.array_max(m), "blend", weight))


def selective(p: Pair, threshold: float, named: bool = False) -> Column:
    """The user where sure, else the assistant where sure, else the user; the name has no threshold unless asked for."""
    name = "selective_prediction" + (f"_{threshold:.2f}" if named else "")
    helps = (p.cu < threshold) & (p.ca >= threshold)
    return decide(name, F.when(helps, p.a).otherwise(p.u), 1.0, F.when(helps, p.assist_share).otherwise(p.user_share), F.when(helps, "assist").otherwise("defer"))


def conf_gate(p: Pair, threshold: Column | float, tau: Column | float, name: Column | str | None = None) -> Column:
    """The assistant where its confidence reaches the threshold (0 to 1.01)."""
    if not isinstance(threshold, Column) and not 0 <= threshold <= 1.01:
        raise ValueError("threshold must lie in [0, 1.01]")
    helps = p.ca >= _d(threshold)
    return decide(name if name is not None else f"plain_conf_threshold_{threshold:.2f}", F.when(helps, p.a).otherwise(p.u), tau, F.when(helps, p.ca).otherwise(p.cu), F.when(helps, "assist").otherwise("defer"))


def set_budget(p: Pair, tau: float) -> Column:
    helps = (p.ca > p.cu) & (F.greatest(F.lit(0.0), p.cu - F.element_at(p.pu, p.a + 1)) <= tau)
    return decide(f"set_acsa_tau_{tau:.2f}", F.when(helps, p.a).otherwise(p.u), tau, F.when(helps, p.assist_share).otherwise(p.user_share), F.when(helps, "agency_set").otherwise("user"))


def budget_margin(p: Pair, tau: Column | float, action: Column) -> Column:
    """What an action leaves of the budget."""
    return _d(tau) - F.greatest(F.lit(0.0), p.cu - F.element_at(p.pu, action + 1))


def _actions(p: Pair) -> Column:
    return F.sequence(F.lit(0), F.size(p.pu) - 1)


def masked_probs(p: Column, allowed: Column, action: Column) -> Column:
    """p within the allowed actions, renormalised; the action's own vector if nothing is left; its argmax is the action."""
    index = F.sequence(F.lit(0), F.size(p) - 1)
    kept = F.zip_with(p, index, lambda x, i: F.when(F.array_contains(allowed, i), x).otherwise(0.0))
    alone = F.transform(index, lambda i: (i == action).cast("double"))
    lifted = lambda q: let(F.array_max(q), lambda top: normalize(F.zip_with(q, index, lambda x, i: F.when(i == action, top + 1e-9).otherwise(x))))
    own = lambda k: let(total(k), lambda mass: F.when(mass > 0, F.transform(k, lambda x: x / mass)).otherwise(alone))
    return let(let(kept, own), lambda q: F.when(argmax(q) == action, q).otherwise(lifted(q)))


def margin_budget(p: Pair, tau: float, gain: float = 0.0) -> Column:
    """Of the actions within the budget the one most likely to the assistant, if likelier than the user's own to the user."""

    def chosen(b: Column) -> Column:
        helps = F.coalesce(-b["n"] > p.cu + gain, F.lit(False))
        return decide(f"agency_margin_tau_{tau:.2f}", F.when(helps, b["i"]).otherwise(p.u), tau, F.when(helps, -b["n"]).otherwise(p.cu), F.when(helps, "agency_margin").otherwise("user"))

    best = lambda r: F.get(F.filter(r, lambda s: _d(tau) - s["ali"] >= -EPS), F.lit(0))
    return let(best(p.ranked), chosen)


class Staged(Pair):
    """A Pair whose values are columns already, so that every policy shares them: one sort of a row's actions serves all budgets."""

    ranked = property(lambda self: F.col("_ranked"))

    def __init__(self):
        self.pu, self.pa = F.col("p_user"), F.col("p_assist")
        self.u, self.a, self.cu, self.ca, self.su, self.sa = (F.col(f"_{c}") for c in ("u", "a", "cu", "ca", "su", "sa"))


STAGED = ("_u", "_a", "_cu", "_ca", "_su", "_sa", "_ranked")


def stage(df: DataFrame) -> DataFrame:
    """Adds what a Staged pair reads; a table that was staged before stays as it is."""
    if "_ranked" in df.columns:
        return df
    p = Pair()
    out = df.withColumns({"_u": p.u, "_a": p.a, "_cu": p.cu, "_ca": p.ca, "_su": p.su, "_sa": p.sa})
    return out.withColumn("_ranked", Pair.ranked.fget(Staged()))


def chosen_probs(p: Pair, source: Column, action: Column, tau: Column, weight: Column) -> Column:
    """The normalised vector that a decision stands for, from its source."""
    allowed = F.filter(_actions(p), lambda i: budget_margin(p, tau, i) >= -EPS)
    return F.when(source.isin("user", "defer"), normalize(p.pu)).when(source.isin("assist", "agency_set"), normalize(p.pa)).when(source == "blend", normalize(mixture(p, weight))).otherwise(masked_probs(p.pa, allowed, action))


def expand(df: DataFrame, grid: Column) -> DataFrame:
    """One row per trace and policy of the grid, with the fields that follow from the decision."""
    own, p = [c for c in df.columns if c not in STAGED], Staged()
    x, tau = F.col("d.selected_action"), F.col("d.tau")
    ali = F.greatest(F.lit(0.0), F.col("_cu") - F.element_at("p_user", x + 1))
    return (
        stage(df)
        .withColumn("d", F.explode(grid))
        .withColumn("probs", chosen_probs(p, F.col("d.source"), x, tau, F.col("d.weight")))
        .select(
            *own,
            "d.policy",
            x.alias("selected_action"),
            "probs",
            tau.alias("tau"),
            "d.coverage",
            "d.source",
            (x != F.col("_u")).alias("intervene"),
            ali.alias("expected_ali"),
            (tau - ali).alias("margin"),
            F.element_at("probs", x + 1).alias("confidence"),
            (x == F.col("label")).alias("correct"),
            (F.coalesce("prefix_time_s", "timestamp_s") * 1000).alias("decision_time_ms"),
        )
    )


def grid(taus: Iterable[float] = TAUS, weights: Iterable[float] = (0.25, 0.5, 0.75), thresholds: Iterable[float] = (0.6, 0.7, 0.8), named: bool = False) -> Column:
    p = Staged()
    out = [user_only(p), assist_only(p), *[blend(p, w) for w in weights], *[selective(p, t, named) for t in thresholds]]
    for t in taus:
        out += [set_budget(p, t), margin_budget(p, t)]
    return F.array(*out)


def policy_grid(df: DataFrame, taus: Iterable[float] = TAUS, weights: Iterable[float] = (0.25, 0.5, 0.75), thresholds: Iterable[float] = (0.6, 0.7, 0.8), named: bool = False) -> DataFrame:
    return expand(df, grid(taus, weights, thresholds, named))


#: Columns of decision_frame(), in order; columns of a trace that bear one of these names get META before it.
FRAME = (
    "dataset_id", "split_id", "split_family", "policy", "subject_id", "session", "day", "label", "selected_action", "user_action", "assist_action", "timestamp_s", "selected_confidence", "coverage_confidence", "control_source",
    "action_changed", "autonomy_used", "intervene", "defer", "abstain", "expected_utility", "expected_ali", "tau", "agency_margin", "decision_time_ms", "correct",
)
META = "meta_"


def decision_frame(decisions: DataFrame, metadata: list[str] | None = None) -> DataFrame:
    """The flat table of decisions: the fields of FRAME, then the metadata columns.

    A metadata column (by default all that isn't a field of a decision or a posterior)
    whose name is taken gets META before it. Without them prefix_time_s is timestamp_s
    and episode_id is empty; a frame without split_family takes it from split_id.
    expected_utility is what the vector that was followed gives the action: the user's,
    the assistant's or the mixture's. No policy abstains.
    """
    x, source = F.col("selected_action"), F.col("source")
    user, assist = (F.element_at(f"p_{r}", x + 1) for r in ("user", "assist"))
    own = {
        "split_family": F.split_part("split_id", F.lit("|"), F.lit(1)),
        "user_action": argmax(F.col("p_user")),
        "assist_action": argmax(F.col("p_assist")),
        "selected_confidence": F.col("confidence"),
        "coverage_confidence": F.col("coverage"),
        "control_source": F.when(source == "defer", "user").otherwise(source),
        "action_changed": F.col("intervene"),
        "autonomy_used": F.col("intervene"),
        "defer": source == "defer",
        "abstain": F.lit(False),
        "expected_utility": F.when(source.isin("user", "defer"), user).when(source == "blend", F.col("confidence")).otherwise(assist),
        "agency_margin": F.col("margin"),
    }
    used = {"p_user", "p_assist", "probs", "source", "coverage", "confidence", "margin"}
    kept = [c for c in decisions.columns if c not in used and (c in own or c not in FRAME)] if metadata is None else metadata
    more = {f"{META}{c}" if c in FRAME else c: F.col(c) for c in kept}
    more.setdefault("prefix_time_s", F.col("timestamp_s"))
    more.setdefault("episode_id", F.lit(""))
    return decisions.select(*[own.get(c, F.col(c)).alias(c) for c in FRAME], *[c.alias(n) for n, c in more.items()])


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Decisions that break a rule, with the first such rule's name; empty when all is well. A field that is null, NaN or infinite breaks its rule."""
    x, k, label = F.col("selected_action"), F.size("probs"), F.col("label")
    none = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    off = lambda test: F.coalesce(test, F.lit(True))
    rule = (
        F.when(off((x < 0) | (x >= k) | (label < 0) | (label >= k)) | F.col("probs").isNull(), "class index")
        .when(none("tau") | (F.col("tau") < 0), "tau")
        .when(none("expected_ali") | (F.col("expected_ali") < 0), "expected_ali")
        .when(none("margin") | off(F.abs(F.col("margin") - (F.col("tau") - F.col("expected_ali"))) > 1e-9), "margin")
        .when(off(argmax(F.col("probs")) != x), "argmax")
        .when(none("confidence") | off(F.abs(F.col("confidence") - F.element_at("probs", x + 1)) > 1e-9), "confidence")
        .when(none("coverage") | (F.col("coverage") < 0) | (F.col("coverage") > 1), "coverage")
    )
    return decisions.withColumn("rule", rule).where("rule is not null")


def policy_family(policy: Column) -> Column:
    out = F.lit("other")
    for prefix, family in reversed([("user_only", "user"), ("assist_only", "assist"), ("confidence_blend", "blend"), ("selective", "selective"), ("agency_margin", "margin"), ("set_acsa", "set"), ("plain_conf", "gate")]):
        out = F.when(policy.startswith(prefix), family).otherwise(out)
    return out


def tau_token(policy: Column) -> Column:
    """The two-decimal token after `tau_`, else null."""
    return F.when(F.regexp_extract(policy, r"tau_([0-9]+\.[0-9]{2})$", 1) != "", F.regexp_extract(policy, r"tau_([0-9]+\.[0-9]{2})$", 1))
