"""Many one-class SVM problems over the same rows, solved together.

A problem asks for the shortest vector in { sum a_i z(x_i) : 0 <= a_i <= 1/(nu n), sum a_i = 1 }. The extreme points of that
set are means of z over the rows below a cut in some direction. A round has two passes over the rows whatever the number of
problems still open: one aggregate of all their cuts, one component-wise sum of all their points; then a tiny quadratic
problem each on the driver. So passes grow with the rounds of the slowest problem only. Two more passes a round keep the
rounds few: one draws a bounded sample, mostly from the low scores, one sums the points of all rows in the directions that
solve it, which tasks of their own find, one per problem. The gap that ends a fit is always that of all rows.

Every point is kept as its direction, cut and number of rows. A row's dual coefficient is then the sum of share / rows over
the points it belongs to, and needs no list of rows.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowlens.detect.base import matrix_column
from flowlens.operators.quantiles import exact_percentiles

#: Rounds after which a fit without a limit of its own fails.
MAX_ROUNDS = 1_000
#: Share of the longest point's squared length that counts as zero.
ZERO = 1e-12
#: Relative difference between two computations of one score; the row at the cut must not drop out by it.
SAME = 1e-9
#: Rows, and numbers per array, of the sample whose solution says where to begin.
START_ROWS, START_SIZE = 20_000, 8_000_000
#: Numbers per array of a later sample.
SAMPLE_SIZE = 32_000_000
#: Tails of a problem's scores, in units of nu, that its later samples are drawn from, and the rows of each and of the rest.
TAILS, TAIL_ROWS, REST_ROWS = (3.0, 30.0, 300.0), 32_000, 32_000
MOST_DRAWN = 4 * (REST_ROWS + TAIL_ROWS * len(TAILS))
#: Cuts tried for a direction of a sample, in standard errors of the sampled share.
SPARES = (0.0, 0.5, 1.0, 2.0)
#: Relative gap to which the first, plain sample is solved; later samples start from its direction.
FIRST_GAP = 0.05
#: Numbers of a feature map that a task holds at once; they stay in a core's cache.
BLOCK = 256_000
#: A cut is sought this much above nu, twice what the sketch may be off by, so that no point has fewer rows than nu of all.
ABOVE = 0.01


@dataclass
class Problem:
    fmap: object
    nu: float
    tol: float
    max_iter: int | None
    atoms: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    shares: np.ndarray = field(default_factory=lambda: np.ones(1))
    ways: list = field(default_factory=list)     # (direction, cut, rows) of every atom
    gap: float = 0.0
    rounds: int = 0
    rho: float = 0.0
    longest: float = 0.0
    open: bool = True

    @property
    def weights(self) -> np.ndarray:
        return self.shares @ self.atoms

    def settle(self, steps: int = 200_000) -> None:
        """New shares for the atoms; those without one are dropped."""
        self.shares = shares_of(self.atoms, self.shares, self.tol / 100, ZERO * self.longest / 100, steps)
        used = np.flatnonzero(self.shares > 0)
        self.atoms, self.shares, self.ways = self.atoms[used], self.shares[used], [self.ways[i] for i in used]

    def add(self, atom: np.ndarray, way: tuple) -> None:
        self.atoms, self.shares = np.vstack([self.atoms, atom]), np.append(self.shares, 0.0)
        self.ways.append(way)
        self.longest = max(self.longest, float(atom @ atom))

    def near(self, gap: float) -> bool:
        w = self.weights
        return gap <= max(self.tol * float(w @ w), ZERO * self.longest)


def solve(rows: DataFrame, problems: list[Problem]) -> int:
    """Fills in weights, ways, gap and rho of every problem; ``rows`` has the struct ``x``. Returns the number of rows."""
    maps = list({id(p.fmap): p.fmap for p in problems}.values())
    place = {id(m): i for i, m in enumerate(maps)}
    means = sums(rows, maps, [(i, None, None) for i in range(len(maps))])
    total = float(means[0][0, -1])
    if total == 0:
        raise ValueError("no training rows")
    for p in problems:
        mean = means[place[id(p.fmap)]][0, :-1] / total
        p.atoms, p.shares, p.longest = mean[None], np.ones(1), float(mean @ mean)
        p.ways, p.open = [(np.zeros(len(mean)), 0.0, total)], p.nu < 1
    _start(rows, maps, place, [p for p in problems if p.open and p.max_iter is None], total)
    distinct = float(rows.agg(F.approx_count_distinct(F.xxhash64("x"))).first()[0]) if any(
        p.open and p.max_iter is None for p in problems) else total
    while running := [p for p in problems if p.open]:
        scored = rows.select("x", _scores(running))
        cuts, tails = _cuts(scored, running)
        jobs = [(place[id(p.fmap)], p.weights[:, None], np.array([cut + SAME * abs(cut)])) for p, cut in zip(running, cuts)]
        for p, (_, direction, cut), made in zip(running, jobs, sums(rows, maps, jobs)):
            _round(p, direction[:, 0], float(cut[0]), made[0, :-1], float(made[0, -1]), total)
        wanted = [i for i, p in enumerate(running) if p.open and p.max_iter is None]
        _refine(rows, scored, maps, place, running, wanted, tails, total, min(total, max(1.0, distinct)))
    _offsets(rows, problems)
    return int(total)


def _round(p: Problem, w: np.ndarray, cut: float, below: np.ndarray, n: float, total: float) -> None:
    if n == 0:
        raise ValueError("no training row has a finite score")
    wanted = p.nu * total
    # The rows beyond nu of all score no more than the cut; without them the mean can't be higher than this.
    p.gap = float(w @ w) - (float(w @ below) - max(0.0, n - wanted) * cut) / min(n, wanted)
    if p.near(p.gap):
        p.open = False
        return
    if p.rounds == (MAX_ROUNDS if p.max_iter is None else p.max_iter):
        text = f"gap {p.gap:.3g} after {p.rounds} rounds is above {p.tol:g} of the squared length {float(w @ w):.3g}"
        if p.max_iter is None:
            raise RuntimeError(text)
        warnings.warn(text, RuntimeWarning, stacklevel=5)
        p.open = False
        return
    p.rounds += 1
    p.add(below / n, (w, cut, n))
    p.settle()


def _scores(problems: list[Problem]):
    pairs = [(p.fmap, p.weights) for p in problems]

    def score(rows: np.ndarray) -> np.ndarray:
        images = {id(fmap): fmap(rows) for fmap in {id(m): m for m, _ in pairs}.values()}
        return np.stack([images[id(fmap)] @ w for fmap, w in pairs], axis=1)

    return matrix_column(in_blocks(score, max(len(w) for _, w in pairs)), F.col("x"), "array<double>").alias("s")


def in_blocks(function, width: int):
    """The same function of rows, called for as many at a time as keep ``width`` numbers a row within ``BLOCK``."""
    step = max(1, BLOCK // width)

    def run(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([function(rows[i : i + step]) for i in range(0, max(len(rows), 1), step)])

    return run


def _cuts(scored: DataFrame, problems: list[Problem]) -> tuple[list[float], list[list[float]]]:
    """A score just above the nu-quantile for every problem and those that end its tails, from one aggregate."""
    found = scored.agg(*[
        F.percentile_approx(F.get("s", F.lit(i)), [min(1.0, p.nu * part) for part in (1 + ABOVE, *TAILS)],
                            max(10_000, math.ceil(1 / (ABOVE * p.nu)))).alias(f"c{i}")
        for i, p in enumerate(problems)]).first()
    return [c[0] if c else None for c in found], [c[1:] if c else None for c in found]


def _offsets(rows: DataFrame, problems: list[Problem]) -> None:
    """Exact nu-quantiles of the final scores; with nu = 1 the offset is free, and the median is used."""
    shares = [p.nu if p.nu < 1 else 0.5 for p in problems]
    scored = rows.select(_scores(problems)).persist()
    try:
        columns = {str(i): F.get("s", F.lit(i)) for i in range(len(problems))}
        found = exact_percentiles(scored, columns, sorted(set(shares)))
    finally:
        scored.unpersist()
    for i, (p, share) in enumerate(zip(problems, shares)):
        p.rho = found[(str(i), share)]


def sums(rows: DataFrame, maps: list, jobs: list[tuple]) -> list[np.ndarray]:
    """For each job (number of its map, directions by column, cuts, and the column of each cut if not one each): a row per
    cut with the sum of z over the rows below it and their number; all rows without directions.

    Each task adds up its batches, block by block; the lines of the tasks are summed in a shuffle, so what reaches the
    driver is one line per cut, however many tasks there are. A block is mapped once for all jobs of a map, and only its rows
    below some cut are added.
    """
    size = len(rows.schema["x"].dataType.fields)
    width = {i: len(maps[i](np.zeros((1, size)))[0]) + 1 for i in {job[0] for job in jobs}}
    step = max(1, BLOCK // max(width.values()))
    plans, order, at = [], [], 0
    for i in width:
        whole = [k for k, job in enumerate(jobs) if job[0] == i and job[1] is None]
        cutting = [k for k, job in enumerate(jobs) if job[0] == i and job[1] is not None]
        order += [(k, 0, at) for k in whole]
        at += bool(whole)
        which, cuts, first = [], [], 0
        for k in cutting:
            _, directions, own, *columns = jobs[k]
            which.append(first + (np.asarray(columns[0]) if columns else np.arange(len(own))))
            cuts.append(own)
            first += directions.shape[1]
            order += [(k, j, at + j) for j in range(len(own))]
            at += len(own)
        joined = [np.concatenate(part) for part in (which, cuts)] if cutting else None
        plans.append((i, bool(whole), np.hstack([jobs[k][1] for k in cutting]) if cutting else None, joined))

    def partial(batches):
        made = None
        for batch in batches:
            rows = batch.to_numpy(dtype=float, na_value=np.nan)
            for start in range(0, len(rows), step):
                parts = []
                for i, whole, directions, joined in plans:
                    z = maps[i](rows[start : start + step])
                    if whole:
                        parts.append(np.append(np.ones(len(z)) @ z, len(z))[None])
                    if directions is not None:
                        below = (z @ directions)[:, joined[0]] <= joined[1]
                        hit = below.any(axis=1)
                        below = below[hit].astype(float)
                        parts.append(np.hstack([below.T @ z[hit], below.sum(axis=0)[:, None]]))
                made = parts if made is None else [a + b for a, b in zip(made, parts)]
        if made is not None:
            lines = [line for part in made for line in part]
            yield pd.DataFrame({"k": np.arange(len(lines)), "values": lines})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": group["k"].iloc[:1], "values": [np.sum(np.stack(group["values"].to_numpy()), axis=0)]})

    schema = "k long, values array<double>"
    summed = rows.select("x.*").mapInPandas(partial, schema).groupBy("k").applyInPandas(add, schema).toPandas()
    lines = [np.asarray(line, dtype=float) for line in summed.sort_values("k")["values"]]
    out = [np.zeros((1 if job[1] is None else len(job[2]), width[job[0]])) for job in jobs]
    for k, j, line in order:
        if lines:
            out[k][j] = lines[line]
    return out


def _start(rows: DataFrame, maps: list, place: dict, problems: list[Problem], total: float) -> None:
    """Points of all rows in the directions that solve a bounded sample; only those of nu of the rows or more."""
    if not problems:
        return
    widest = max(p.atoms.shape[1] for p in problems)
    most = max(100, min(START_ROWS, START_SIZE // widest))
    spot = F.pmod(F.xxhash64("x"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows if total <= most else rows.where(spot < most / total).limit(2 * most)
    every = F.explode(F.sequence(F.lit(0), F.lit(len(problems) - 1))).alias("problem")
    tols = [FIRST_GAP if total > most else p.tol / 2 for p in problems]
    found = _solved(sample.select(every, F.lit(1.0).alias("weight"), "x.*"), problems, tols, [total > most] * len(problems))
    _add_points(rows, maps, place, found, total)


def _refine(rows: DataFrame, scored: DataFrame, maps: list, place: dict, problems: list[Problem], wanted: list[int],
            tails: list[list[float]], total: float, distinct: float) -> None:
    """Points of all rows in the directions that solve a weighted sample for every wanted problem.

    Nearly all of a sample comes from the low scores, where the next points lie, and the rest stands for the other rows.
    Equal rows are drawn together, as one row and their number; so it is the number of distinct rows that sets the rates.
    """
    if not wanted:
        return
    spot = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rest = min(1.0, REST_ROWS / distinct)
    rates = {i: [max(rest, min(1.0, TAIL_ROWS / (part * problems[i].nu * distinct))) for part in TAILS] for i in wanted}

    def rate(i: int):
        column = F
        for cut, share in zip(tails[i], rates[i]):
            column = column.when(F.get("s", F.lit(i)) <= F.lit(cut), F.lit(share))
        return column.otherwise(F.lit(rest))

    kept = F.greatest(F.lit(rest), F.lit(0.0), *[rate(i) for i in wanted])
    drawn = scored.select("x", "s", spot.alias("u")).where(F.col("u") < kept).groupBy("x").agg(
        F.first("s").alias("s"), F.first("u").alias("u"), F.count("*").alias("n"))
    own = F.array(*[F.struct(F.lit(k).alias("problem"), rate(i).alias("rate")) for k, i in enumerate(wanted)])
    each = drawn.select("x", "u", "n", F.inline(own)).where("u < rate").select("problem", (F.col("n") / F.col("rate")).alias("weight"), "x.*")
    mine = [problems[i] for i in wanted]
    _add_points(rows, maps, place, _solved(each, mine, [p.tol / 2 for p in mine],
                                           [min(rates[i] + [rest]) < 1 for i in wanted]), total)


def _solved(sample: DataFrame, problems: list[Problem], tols: list[float], sampled: list[bool]) -> list[tuple]:
    """Each problem with the directions that solve its rows of ``sample(problem, weight, features...)``, in a task each.

    A task takes its rows in an order of their own, so that how they arrive changes nothing, and no more of them than
    ``SAMPLE_SIZE`` allows. It reads ``MOST_DRAWN`` at most, which only many different rows of one score exceed.
    """
    features = sample.columns[2:]
    light = [Problem(p.fmap, p.nu, p.tol, None, p.atoms, p.shares, longest=p.longest) for p in problems]

    def solve_one(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += len(batch)
            if n >= MOST_DRAWN:
                break
        if not n:
            return
        rows = pd.concat(parts)
        k = int(rows["problem"].iloc[0])
        p, x = light[k], rows[features].to_numpy(dtype=float, na_value=np.nan)
        order = np.lexsort([*x.T, rows["weight"].to_numpy()])
        order = order[np.random.default_rng(len(order)).permutation(len(order))][: max(100, SAMPLE_SIZE // p.atoms.shape[1])]
        z, weights = in_blocks(p.fmap, p.atoms.shape[1])(x[order]), rows["weight"].to_numpy(dtype=float)[order]
        fine = np.isfinite(z).all(axis=1)
        if not fine.all():
            z, weights = z[fine], weights[fine]
        if len(z):
            for at, (w, cuts) in enumerate(_directions(z, weights, p, tols[k], sampled[k])):
                yield pd.DataFrame({"problem": [k], "at": [at], "w": [w], "cuts": [cuts]})

    dealt = sample.repartitionById(len(problems), F.col("problem"))
    ways = dealt.mapInPandas(solve_one, "problem int, at int, w array<double>, cuts array<double>").toPandas()
    ways = ways.sort_values(["problem", "at"])
    return [(p, [(np.asarray(r.w, dtype=float), np.asarray(r.cuts, dtype=float))
                 for r in ways[ways["problem"] == k].itertuples()]) for k, p in enumerate(problems)]


def _add_points(rows: DataFrame, maps: list, place: dict, samples: list[tuple], total: float) -> None:
    """The points of all rows for the ways of every problem: of the cuts of a direction the lowest with nu of the rows."""
    jobs, owners = [], []
    for p, ways in samples:
        ways = ways[-max(1, START_SIZE // 50 // p.atoms.shape[1]):]
        if ways:
            cuts = np.concatenate([cuts for _, cuts in ways])
            way = np.repeat(np.arange(len(ways)), [len(cuts) for _, cuts in ways])
            jobs.append((place[id(p.fmap)], np.stack([w for w, _ in ways], axis=1), cuts + SAME * np.abs(cuts), way))
            owners.append(p)
    if not jobs:
        return
    for p, (_, directions, cuts, way), made in zip(owners, jobs, sums(rows, maps, jobs)):
        enough = made[:, -1] >= p.nu * total
        for one in np.unique(way[enough]):
            j = np.flatnonzero(enough & (way == one))[np.argmin(made[enough & (way == one), -1])]
            p.add(made[j, :-1] / made[j, -1], (directions[:, one], float(cuts[j]), float(made[j, -1])))
        p.settle()


def _directions(z: np.ndarray, weights: np.ndarray, p: Problem, tol: float, sampled: bool) -> list[tuple]:
    """Directions, each with a few cuts, of the points that the solution over weighted rows adds to the problem's own."""
    own = Problem(p.fmap, p.nu, p.tol, None, p.atoms, p.shares, [(None, None)] * len(p.atoms), longest=p.longest)
    everything = float(weights.sum())
    for _ in range(MAX_ROUNDS):
        w = own.weights
        scores = z @ w
        order = np.argsort(scores)
        reached = np.cumsum(weights[order])
        k = min(len(z) - 1, int(np.searchsorted(reached, p.nu * everything * (1 - SAME))))
        error = 1.0 / math.sqrt(k + 1) if sampled else 0.0
        shares = [p.nu * (1 + spare * error) for spare in (SPARES if sampled else SPARES[:1])]
        places = np.minimum(len(z) - 1, np.searchsorted(reached, np.array(shares) * everything * (1 - SAME)))
        below = order[: k + 1]
        atom = weights[below] @ z[below] / weights[below].sum()
        own.longest = max(own.longest, float(atom @ atom))
        if float(w @ (w - atom)) <= max(tol * float(w @ w), ZERO * own.longest / 2):
            break
        own.add(atom, (w, np.unique(scores[order[places]])))
        own.settle(20_000)
    return [way for way in own.ways if way[0] is not None]


def shares_of(atoms: np.ndarray, shares: np.ndarray, tol: float = 0.0, least: float = 1e-12,
              steps: int = 200_000) -> np.ndarray:
    """Shares of the atoms in the shortest vector of their hull.

    The atom of the lowest slope joins those in use, whose best shares are one small linear system; those that it would give
    a share below 0 leave on the way there. It ends when no atom gains enough, or none makes the vector shorter any more.
    """
    gram = atoms @ atoms.T
    shares = shares / shares.sum()
    for _ in range(min(steps, 20 * len(atoms) + 1_000)):
        slope = gram @ shares
        length, to = float(shares @ slope), int(np.argmin(slope))
        away = float(slope[shares > 0].max())
        if away - slope[to] <= max(tol * length, least):
            break
        new = shares.copy()
        used = new > 0
        used[to] = True
        while True:
            at = np.flatnonzero(used)
            best = _affine(gram[np.ix_(at, at)])
            if (best > 0).all():
                new[at] = best
                break
            falling = best < new[at]
            ends = falling & (best <= 0)
            if not ends.any():
                break
            ratios = np.where(ends, new[at] / np.where(ends, new[at] - best, 1.0), np.inf)
            move = min(1.0, float(ratios.min()))
            new[at] += move * (best - new[at])
            new[at[np.argmin(ratios)]] = 0.0
            new = np.maximum(new, 0.0)
            used[at[np.argmin(ratios)]] = False
            used &= (new > 0)
            if not used.any():
                break
        if not new.sum() > 0:
            break
        new /= new.sum()
        if float(new @ gram @ new) >= length:
            break
        shares = new
    return shares


def _affine(gram: np.ndarray) -> np.ndarray:
    """Shares, of any sign, of the shortest vector in the plane through all atoms."""
    scale = max(float(np.abs(gram).max()), 1e-300)
    system = np.block([[gram / scale, np.ones((len(gram), 1))], [np.ones((1, len(gram))), np.zeros((1, 1))]])
    return np.linalg.lstsq(system, np.append(np.zeros(len(gram)), 1.0), rcond=None)[0][:-1]


def shortest(atoms: np.ndarray) -> np.ndarray:
    """Shortest vector in the convex hull of a handful of atoms."""
    start = np.zeros(len(atoms))
    start[int(np.argmin((atoms * atoms).sum(axis=1)))] = 1.0
    return shares_of(atoms, start) @ atoms
