"""Planning and run grids: plan expansion, override grids, winners, cost of networks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Energy of a multiply-accumulate and of an accumulate, in pJ (fixed values).
PJ_MAC, PJ_AC = 4.6, 0.9


def uniform(seed: int, *keys: str) -> Column:
    """A repeatable uniform number in [0, 1) of a row's keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def triangular(u: Column, lo: float, mode: float, hi: float) -> Column:
    """Inverse distribution function of the triangular law."""
    c = (mode - lo) / (hi - lo)
    return F.when(u < c, lo + F.sqrt(u * ((hi - lo) * (mode - lo)))).otherwise(hi - F.sqrt((1 - u) * ((hi - lo) * (hi - mode))))


def target_snr(u: Column, v: Column, floor: float = -20.0, hi: float = 40.0, share: float = 0.15) -> Column:
    """A share of targets lies below the floor, uniformly; the others follow a triangular law."""
    return F.when(u < share, floor - 15 + 15 * v).otherwise(triangular(v, floor, 5.0, hi))


def expand(cells: DataFrame, n: str, first_id: int, keys: list[str], out: str = "scene_id") -> DataFrame:
    """Every cell n times, with contiguous ids in the cells' order from ``first_id``."""
    before = F.coalesce(F.sum(n).over(Window.partitionBy(F.lit(0)).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = cells.withColumn("_b", before).filter(F.col(n) > 0)
    return t.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))).withColumn(out, first_id + F.col("_b") + F.col("_j")).drop("_b", "_j")


def run_grid(base: dict, overrides: DataFrame, replicates: int, skip: DataFrame | None = None) -> DataFrame:
    """label x replicate rows: each setting is the override if there is one, else the base's."""
    t = overrides.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    for k, v in base.items():
        t = t.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in overrides.columns else F.lit(v))
    t = t.withColumn("run_id", F.format_string("%s_rep%d", "label", "replicate"))
    return t.join(skip, "run_id", "left_anti") if skip is not None else t


def winners(df: DataFrame, by: str, tie: str, k: int, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(tie))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def cost_model(n_in: Column, widths: Column, rank: Column, heads: Column, steps: Column, stem_once: Column, rates: Column) -> dict[str, Column]:
    """macs, sops, energy_uj and ratio of a spiking network with one row of settings.

    The first layer (through a low-rank pair if ``rank`` > 0) sees real numbers: a multiply-accumulate in
    every time step, or once. Later layers and the heads add at the rate of the layer below. ``ratio`` is
    the energy of the network without spikes over this one's; missing rates repeat the last.
    """
    first = F.element_at(widths, 1)
    stem = F.when(rank > 0, n_in * rank + rank * first).otherwise(n_in * first).cast("double")
    outs = F.concat(F.slice(widths, 2, F.size(widths)), F.array(heads))
    later = F.zip_with(widths, outs, lambda a, b: (a * b).cast("double"))
    rate = F.transform(F.sequence(F.lit(1), F.size(widths)), lambda i: F.element_at(rates, F.least(i, F.size(rates))))
    add = lambda acc, x: acc + x
    macs = stem + F.aggregate(later, F.lit(0.0), add)
    sops = F.aggregate(F.zip_with(later, rate, lambda m, r: m * r), F.lit(0.0), add) * steps
    picojoule = stem * F.when(stem_once, F.lit(1)).otherwise(steps) * PJ_MAC + sops * PJ_AC
    return {"macs": macs, "sops": sops, "energy_uj": picojoule / 1e6, "ratio": F.try_divide(macs * PJ_MAC, picojoule)}


#: Fixed values of the wave solver's stencil: surface wave floor (m/s), radius in km as quality and velocity allow
#: (factor, Hz, bounds), stiff ground (m/s), seconds after the slowest wave (soft, stiff, more for an inverse profile),
#: largest wavenumber (margin, Hz, bounds), number of wavenumbers (share of the largest, per second of window, bounds),
#: time step (s), damping (per wavenumber step, per window).
STENCIL = {
    "least_vr": 80.0, "radius": (6.9, 25.0, 0.06, 0.32), "stiff_vs": 800.0, "after_s": (2.5, 1.5, 1.5),
    "kmax": (1.25, 250.0, 10_000.0, 24_000.0), "nk": (0.85, 0.239, 8_000.0, 30_000.0), "step_s": 0.002, "alpha": (2.15, 9.0),
}


def stencil(vr: Column, q: Column, vs_top: Column, inverse: Column, vp_max: Column) -> dict[str, Column]:
    """r_max, kmax, nk, nt and alpha of the wave solver for a profile (velocities in m/s, vp in km/s).

    Wavenumbers reach the slowest surface wave and the near field; their number pushes the ghosts of the
    discrete sum out of the window, as far as the cap allows; alpha damps what remains.
    """
    within = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    v = F.greatest(vr, F.lit(STENCIL["least_vr"])) / 1000
    factor, hz, *bounds = STENCIL["radius"]
    r_max = within(factor * q * v / (F.pi() * hz), *bounds)
    soft, stiff, more = STENCIL["after_s"]
    after = F.when((vs_top >= STENCIL["stiff_vs"]) & ~inverse, stiff).otherwise(soft) + F.when(inverse, more).otherwise(0.0)
    window = r_max / v + after
    margin, hz, *bounds = STENCIL["kmax"]
    kmax = within(2 * F.pi() * hz * margin / v, *bounds)
    share, rate, *bounds = STENCIL["nk"]
    nk = F.floor(within(F.greatest(share * kmax, rate * kmax * vp_max * window), *bounds)).cast("long")
    per_step, per_window = STENCIL["alpha"]
    pairs = F.ceil(F.round(window / STENCIL["step_s"] / 2, 9))
    return {"r_max": r_max, "kmax": kmax, "nk": nk, "nt": (pairs * 2).cast("long"), "alpha": F.least(per_step * kmax / nk * vp_max, per_window / window)}
