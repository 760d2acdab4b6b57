"""Exact quantiles of numeric values without gathering a column in one task.

Values fall into slices of equal ratio (1024 per factor of two), a fixed,
order-preserving function of the value.  Counts per slice locate the slice of
each wanted rank; slices still too large are cut into equal-width parts.  A
slice spans under 2**43 doubles and is cut into 2**20 parts, so the last step
sorts at most a few million distinct values whatever the size of the input.
"""

from __future__ import annotations

SLICES_PER_OCTAVE = 1024
PARTS = 1 << 20
QUARTILES = (0.25, 0.50, 0.75)

_ZERO = 1 << 22
_INFINITE = 1 << 24


def slice_sql(num: str) -> str:
    """Order-preserving slice number; null for null."""
    return (
        f"int(CASE WHEN {num} = 0 THEN 0 "
        f"WHEN abs({num}) = double('infinity') THEN sign({num}) * {_INFINITE} "
        f"ELSE sign({num}) * (floor(log2(abs({num})) * {SLICES_PER_OCTAVE}) + {_ZERO}) END)"
    )


def center_sql(slice_no: str) -> str:
    """A value inside or next to the slice; deviations from it stay small."""
    return (
        f"CASE WHEN {slice_no} = 0 OR abs({slice_no}) = {_INFINITE} THEN 0D "
        f"ELSE sign({slice_no}) * pow(2D, (abs({slice_no}) - {_ZERO} + 0.5D) / {SLICES_PER_OCTAVE}) END"
    )


def _ranks_sql(total: str, probabilities) -> str:
    """The two neighbouring ranks of every probability, as structs."""
    wanted = []
    for i, p in enumerate(probabilities):
        place = f"{p}D * ({total} - 1)"
        for slot, rounded in ((2 * i, "floor"), (2 * i + 1, "ceil")):
            wanted.append(
                f"named_struct('slot', {slot}, 'rank', bigint({rounded}({place})), "
                f"'fraction', {place} - floor({place}))"
            )
    return f"array({', '.join(wanted)})"


def _within(ranks: str, start: str, count: str) -> str:
    return f"filter({ranks}, r -> r.rank >= {start} AND r.rank < {start} + {count})"


def quantile_ctes(values: str, slices: str, probabilities=QUARTILES, part_threshold: int = PARTS) -> str:
    """Common table expressions ending in ``quantiles (pos, quantiles)``.

    ``values`` names ``(pos, num, cnt, slice)``; ``slices`` one row per
    ``(pos, slice)`` with ``num_count`` (weight), ``num_distinct``, ``num_min``
    and ``num_max``.
    """
    found, interpolated = [], []
    for i in range(len(probabilities)):
        found.append(
            f"max(CASE WHEN hit.slot = {2 * i} THEN num END) AS low{i}, "
            f"max(CASE WHEN hit.slot = {2 * i + 1} THEN num END) AS high{i}, "
            f"max(CASE WHEN hit.slot = {2 * i} THEN hit.fraction END) AS fraction{i}"
        )
        interpolated.append(f"if(low{i} = high{i}, low{i}, low{i} + (high{i} - low{i}) * fraction{i})")
    # at most two slices per probability and column are wanted, and as many
    # parts: both broadcast sides are bounded by the number of columns
    return f"""
    placed AS (
      SELECT *, sum(num_count) OVER (PARTITION BY pos ORDER BY slice) - num_count AS start,
             sum(num_count) OVER (PARTITION BY pos) AS total
      FROM {slices} WHERE num_count > 0
    ),
    wanted AS (
      SELECT pos, slice, start, num_min, num_max, num_distinct > {part_threshold} AND num_max > num_min AS cut,
             {_within(_ranks_sql('total', probabilities), 'start', 'num_count')} AS ranks
      FROM placed
    ),
    chosen AS (
      SELECT /*+ BROADCAST(w) */ v.pos, v.slice, v.num, v.cnt, w.start, w.ranks,
             CASE WHEN w.cut THEN least(int(width_bucket(v.num, w.num_min, w.num_max, {PARTS})), {PARTS})
                  ELSE 0 END AS part
      FROM {values} v JOIN wanted w ON v.pos = w.pos AND v.slice = w.slice
      WHERE size(w.ranks) > 0
    ),
    -- the values are read once for them: what is needed of them twice comes out of one shuffle
    dealt AS (SELECT /*+ REPARTITION(pos, slice, part) */ * FROM chosen),
    candidates AS (
      SELECT inline(array(named_struct('pos', pos, 'slice', slice, 'part', part, 'num', num, 'cnt', cnt, 'start', start, 'ranks', ranks)))
      FROM dealt
    ),
    parts AS (
      SELECT pos, slice, part, sum(cnt) AS part_count, any_value(ranks) AS ranks,
             any_value(start) + sum(sum(cnt)) OVER (PARTITION BY pos, slice ORDER BY part) - sum(cnt) AS part_start
      FROM candidates GROUP BY pos, slice, part
    ),
    wanted_parts AS (
      SELECT pos, slice, part, part_start, {_within('ranks', 'part_start', 'part_count')} AS ranks FROM parts
    ),
    ordered AS (
      SELECT /*+ BROADCAST(p) */ c.pos, c.num, c.cnt, p.ranks,
             p.part_start - c.cnt + sum(c.cnt) OVER (
               PARTITION BY c.pos, c.slice, c.part ORDER BY c.num
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_start
      FROM candidates c JOIN wanted_parts p ON c.pos = p.pos AND c.slice = p.slice AND c.part = p.part
      WHERE size(p.ranks) > 0
    ),
    hits AS (SELECT pos, num, explode({_within('ranks', 'value_start', 'cnt')}) AS hit FROM ordered),
    found AS (SELECT pos, {', '.join(found)} FROM hits GROUP BY pos),
    quantiles AS (SELECT pos, array({', '.join(interpolated)}) AS quantiles FROM found)
    """
