"""Random counts out of hashes, as column expressions that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerproof.functions.bind import bound
from answerproof.functions.flags import uniform_of

# Means from here on are drawn by rejection, in constant time; smaller ones by inversion.
REJECT_FROM = 10
# Proposals before the distribution function is inverted after all; about one in four is refused.
TRIES = 16
# Counts further than this from the mean have no mass a double can hold: so many standard deviations
# and so many counts, the latter for skewed distributions of small mean.
TAIL_SD, TAIL_COUNTS = 9, 20


def _series(x: Column) -> Column:
    """log(x!) less the leading terms of Stirling's formula, from its series at x + 1."""
    y = x + 1
    return (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y


def _proposal(v: Column, number: Column) -> Column:
    """One proposal of the transformed rejection of Hörmann (1993), algorithm BTRS; NULL if refused."""

    def judge(d: Column) -> Column:
        k, m, n, us = d["k"], v["m"], v["n"], d["us"]
        bound_ = F.ln(d["w"] * v["alpha"] / (v["a"] / (us * us) + v["b"]))
        mass = (
            (m + 0.5) * F.ln((m + 1) / (v["odds"] * (n - m + 1)))
            + (n + 1) * F.ln((n - m + 1) / (n - k + 1))
            + (k + 0.5) * F.ln(v["odds"] * (n - k + 1) / (k + 1))
            + _series(m) + _series(n - m) - _series(k) - _series(n - k)
        )
        quick = (us >= 0.07) & (d["w"] <= v["vr"])
        return F.when(quick | ((k >= 0) & (k <= n) & (bound_ <= mass)), k.cast("bigint"))

    def propose(d: Column) -> Column:
        place = F.floor((2 * v["a"] / d["us"] + v["b"]) * d["u"] + v["c"]).cast("double")
        return bound({"k": place, "us": d["us"], "w": d["w"]}, judge)

    def spread(d: Column) -> Column:
        return bound({"u": d["u"], "w": d["w"], "us": 0.5 - F.abs(d["u"])}, propose)

    def uniforms(d: Column) -> Column:
        return bound({"u": uniform_of(d["h"]) - 0.5, "w": uniform_of(d["h"], 14)}, spread)

    return bound({"h": F.md5(F.concat_ws("|", v["text"], number.cast("string")))}, uniforms)


def _inverse(v: Column, u: Column) -> Column:
    """The smallest count at which the distribution function reaches u.

    The mass at the low end is known where that end is 0; further up, masses are taken relative to the
    low end and their sum is found first.
    """

    def walk(w: Column) -> Column:
        def following(mass: Column, s: Column) -> Column:
            return mass * (w["more"] / (s + 1) - w["odds"])

        def add(state: Column, s: Column) -> Column:
            return F.struct(
                following(state["mass"], s).alias("mass"), (state["sum"] + state["mass"]).alias("sum")
            )

        def step(state: Column, s: Column) -> Column:
            left = state["left"] - state["mass"]
            return F.struct(
                following(state["mass"], s).alias("mass"), left.alias("left"),
                F.when(left > 0, s + 1).otherwise(state["at"]).alias("at"),
            )

        counts = F.sequence(w["low"], w["high"])
        start = F.struct(w["mass"].alias("mass"), F.lit(0.0).alias("sum"))
        total = F.when(w["low"] == 0, F.lit(1.0)).otherwise(
            F.aggregate(counts, start, add, lambda state: state["sum"])
        )
        begin = F.struct(w["mass"].alias("mass"), (w["u"] * total).alias("left"), w["low"].alias("at"))
        return F.least(w["high"], F.aggregate(counts, begin, step, lambda state: state["at"]))

    reach = F.ceil(TAIL_SD * v["sd"]) + TAIL_COUNTS
    mean = F.floor(v["mean"])
    low = F.greatest(mean - reach, F.lit(0).cast("bigint"))
    values = {
        "low": low, "high": F.least(v["n"].cast("bigint"), mean + reach), "odds": v["odds"],
        "more": (v["n"] + 1) * v["odds"], "u": u,
        "mass": F.when(low == 0, F.exp(v["n"] * F.ln(1 - v["p"]))).otherwise(1.0),
    }
    return bound(values, walk)


def binomial(n: Column, p: Column, text: Column) -> Column:
    """A count drawn from Binomial(n, p) for 0 < p <= 0.5, decided by md5 of ``text`` and "|" with the
    number of the proposal, 1 and up.

    Exact and row-local. A mean of ten or more takes one or two proposals whatever n is; a smaller mean
    inverts the distribution function at the uniform number of proposal 0, some seventy steps at most.
    """

    def draw(v: Column) -> Column:
        inverse = _inverse(v, uniform_of(F.md5(F.concat(v["text"], F.lit("|0")))))
        # later proposals are not evaluated once one is taken
        tried = F.aggregate(
            F.sequence(F.lit(1), F.lit(TRIES)),
            F.lit(None).cast("bigint"),
            lambda found, i: F.coalesce(found, _proposal(v, i)),
        )
        return F.coalesce(F.when(v["mean"] >= REJECT_FROM, tried), inverse)

    def constants(v: Column) -> Column:
        return bound(
            {
                **{c: v[c] for c in ("n", "p", "text", "mean", "sd", "b")},
                "odds": v["p"] / (1 - v["p"]),
                "a": -0.0873 + 0.0248 * v["b"] + 0.01 * v["p"],
                "c": v["mean"] + 0.5,
                "vr": 0.92 - 4.2 / v["b"],
                "alpha": (2.83 + 5.1 / v["b"]) * v["sd"],
                "m": F.floor((v["n"] + 1) * v["p"]).cast("double"),
            },
            draw,
        )

    def moments(v: Column) -> Column:
        sd = F.sqrt(v["n"] * v["p"] * (1 - v["p"]))
        return bound(
            {**{c: v[c] for c in ("n", "p", "text")}, "mean": v["n"] * v["p"], "sd": sd, "b": 1.15 + 2.53 * sd},
            constants,
        )

    return bound({"n": n.cast("double"), "p": p, "text": text}, moments)
