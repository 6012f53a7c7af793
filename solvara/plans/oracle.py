"""DuckDB text for the similarity-driven operators (used only by the correctness oracle).

The samplers are written the plain SQL way -- window functions over the whole set -- which is a
different route from the Spark operators (closed forms over a range-partitioned global rank), so
agreement between the two is a real check.
"""

from __future__ import annotations

from decimal import Decimal

from solvara.plans.fixtures import FX_DOC_SQL


def pct_ratio(pct) -> tuple[int, int]:
    """pct % as an exact integer ratio num/den of 1."""
    d = Decimal(str(pct))
    num, den = d.as_integer_ratio()
    return num, den * 100


def bits_sql(q: int = 4, n_bits: int = 512, source: str = FX_DOC_SQL) -> str:
    """Rows (row_id, bits) with bits = sorted distinct md5-bucketed q-grams of the whole text."""
    gram_bit = (f"CAST((('0x' || substr(md5(substr(s, i, {q})), 1, 8))::BIGINT % {n_bits}) AS INTEGER)")
    return (
        f"SELECT row_id, list_sort(list_distinct(list_transform(range(1, length(s) - {q} + 2), "
        f"lambda i: {gram_bit}))) AS bits FROM (SELECT row_id, coalesce(smiles, '') AS s FROM ({source}) src) x")


def comp_sim_sql(bits_rel: str) -> str:
    """(row_id, comp_sim) from a relation (row_id, bits), leave-one-out JT similarity, exact integers."""
    return f"""
    SELECT row_id, CASE WHEN n < 2 OR a_i + d_i = 0 THEN 0.0
                        ELSE CAST(a_i AS DOUBLE) / CAST(a_i + d_i AS DOUBLE) END AS comp_sim
    FROM (
      SELECT r.row_id, t.n,
             t.big_a - (r.sk - r.m) AS a_i,
             t.big_d + (2 * r.sk - t.n * r.m) AS d_i
      FROM (
        SELECT b.row_id, CAST(count(u.bit) AS HUGEINT) AS m, CAST(coalesce(sum(k.k), 0) AS HUGEINT) AS sk
        FROM {bits_rel} b
        LEFT JOIN (SELECT row_id, unnest(bits) AS bit FROM {bits_rel} z) u ON b.row_id = u.row_id
        LEFT JOIN (SELECT bit, count(*) AS k FROM (SELECT unnest(bits) AS bit FROM {bits_rel} z2) GROUP BY bit) k
               ON u.bit = k.bit
        GROUP BY b.row_id) r,
      (SELECT nn.n,
              CAST(coalesce(sum(CAST(kk.k AS HUGEINT) * (kk.k - 1) // 2), 0) AS HUGEINT) AS big_a,
              CAST(coalesce(sum(CAST(kk.k AS HUGEINT) * (nn.n - 1 - kk.k)), 0) AS HUGEINT) AS big_d
       FROM (SELECT CAST(count(*) AS HUGEINT) AS n FROM {bits_rel} z3) nn
       LEFT JOIN (SELECT bit, count(*) AS k FROM (SELECT unnest(bits) AS bit FROM {bits_rel} z4) GROUP BY bit) kk
              ON TRUE
       GROUP BY nn.n) t
    ) s"""


def stratified_sql(sim_rel: str, pct) -> str:
    """Selected row_ids: NTILE(m) over (comp_sim, row_id), first row of each tile."""
    num, den = pct_ratio(pct)
    return f"""
    SELECT row_id FROM (
      SELECT row_id, row_number() OVER (PARTITION BY tile ORDER BY comp_sim, row_id) AS rn FROM (
        SELECT row_id, comp_sim, ntile(CAST((SELECT count(*) * {num} // {den} FROM {sim_rel} c) AS BIGINT))
               OVER (ORDER BY comp_sim, row_id) AS tile
        FROM {sim_rel} s) t
      WHERE (SELECT count(*) * {num} // {den} FROM {sim_rel} c2) > 0) u
    WHERE rn = 1"""


def quota_sql(sim_rel: str, pct, n_bins: int = 10) -> str:
    """Selected row_ids: equal-width bins, position in bin, first m by (position in bin, bin)."""
    num, den = pct_ratio(pct)
    return f"""
    SELECT row_id FROM (
      SELECT row_id, row_number() OVER (ORDER BY rib, bin) AS rr FROM (
        SELECT row_id, bin, row_number() OVER (PARTITION BY bin ORDER BY comp_sim, row_id) - 1 AS rib FROM (
          SELECT s.row_id, s.comp_sim,
                 CASE WHEN mm.hi > mm.lo
                      THEN least(CAST(floor((s.comp_sim - mm.lo) / (mm.hi - mm.lo) * {n_bins}) AS BIGINT), {n_bins - 1})
                      ELSE 0 END AS bin
          FROM {sim_rel} s, (SELECT min(comp_sim) AS lo, max(comp_sim) AS hi FROM {sim_rel} s2) mm) b) r) q
    WHERE rr <= (SELECT count(*) * {num} // {den} FROM {sim_rel} c)"""


def three_way_split_sql(method: str, pct1, pct2, q: int = 4, n_bits: int = 512,
                        source: str = FX_DOC_SQL) -> str:
    """(row_id, split) for every row of ``source``."""
    sampler = stratified_sql if method == "stratified" else quota_sql
    return f"""
    WITH bits AS MATERIALIZED ({bits_sql(q, n_bits, source)}),
         cs1 AS MATERIALIZED ({comp_sim_sql('bits')}),
         outer_s AS MATERIALIZED ({sampler('cs1', pct1)}),
         bits2 AS MATERIALIZED (SELECT * FROM bits WHERE row_id IN (SELECT row_id FROM outer_s)),
         cs2 AS MATERIALIZED ({comp_sim_sql('bits2')}),
         inner_s AS MATERIALIZED ({sampler('cs2', pct2)})
    SELECT b.row_id,
           CASE WHEN b.row_id IN (SELECT row_id FROM inner_s) THEN 'Training'
                WHEN b.row_id IN (SELECT row_id FROM outer_s) THEN 'Validation'
                ELSE 'Testing' END AS split
    FROM bits b"""


def with_bits(body: str, q: int = 4, n_bits: int = 512, source: str = FX_DOC_SQL) -> str:
    """Prefix ``body`` with a materialized ``bits`` CTE (and ``cs`` = its complementary similarity)."""
    return (f"WITH bits AS MATERIALIZED ({bits_sql(q, n_bits, source)}), "
            f"cs AS MATERIALIZED ({comp_sim_sql('bits')}) {body}")
